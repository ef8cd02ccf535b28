"""Labelled sets: agreement, precision and recall, rank correlation, fits and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import counted_below


def compare_annotations(a: DataFrame, b: DataFrame, fields: Sequence[str], key: str = "doc_id", common_only: bool = False) -> DataFrame:
    """C14. A row for each field in which two annotators differ, arrays taken as sets; without common_only also missing_a and missing_b."""
    plain = lambda df, c: F.array_sort(F.col(c)).cast("string") if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    left = a.select(key, F.lit(True).alias("in_a"), *(plain(a, f).alias(f"a_{f}") for f in fields))
    right = b.select(key, F.lit(True).alias("in_b"), *(plain(b, f).alias(f"b_{f}") for f in fields))
    both = left.join(right, key, "full")
    common = both.where("in_a AND in_b")
    long = common.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("annotator_a"), F.col(f"b_{f}").alias("annotator_b")) for f in fields))).alias("x")).select(key, "x.*")
    diff = long.where(~F.col("annotator_a").eqNullSafe(F.col("annotator_b")))
    if common_only:
        return diff
    missing = both.where("in_a IS NULL OR in_b IS NULL").select(key, F.when(F.col("in_a").isNull(), "missing_a").otherwise("missing_b").alias("field"), F.lit(None).cast("string").alias("annotator_a"), F.lit(None).cast("string").alias("annotator_b"))
    return diff.unionByName(missing)


def disagreement_counts(diff: DataFrame) -> DataFrame:
    """D19. Differences by field."""
    return diff.groupBy("field").agg(F.count("*").alias("n"))


def label_sets(gold: Column, pred: Column) -> list[Column]:
    """C18. hit, miss and extra labels, each in order."""
    return [F.array_sort(F.array_intersect(gold, pred)).alias("hit"), F.array_sort(F.array_except(gold, pred)).alias("miss"), F.array_sort(F.array_except(pred, gold)).alias("extra")]


def adjudicate(a: DataFrame, disagreements: DataFrame, decisions: DataFrame, fields: Sequence[str], key: str = "doc_id") -> DataFrame:
    """C19. Of each item of annotator A: A's values, B's rebuilt from the differences, and the gold: a third party's decision, else A's."""
    wide = disagreements.groupBy(key).pivot("field", list(fields)).agg(F.first("annotator_b"))
    names = wide.select(key, *(F.col(f).alias(f"b_{f}") for f in fields))
    out = a.select(key, *fields).join(names, key, "left").join(decisions.select(key, *(F.col(f).alias(f"d_{f}") for f in fields)), key, "left")
    columns = [c for f in fields for c in (F.coalesce(f"b_{f}", F.col(f).cast("string")).alias(f"b_{f}"), F.coalesce(f"d_{f}", f).alias(f"gold_{f}"))]
    return out.select(key, *fields, *columns)


def ordered_labels(labels: Column, order: Sequence[str]) -> Column:
    """C19. Labels in canonical order."""
    return F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(labels, x))


def worksheet(diff: DataFrame, priority: DataFrame, key: str = "doc_id", n: int | None = None) -> DataFrame:
    """E16. Disputed items with their fields and priority (P1 where none is given), by priority and id."""
    items = diff.groupBy(key).agg(F.array_sort(F.collect_set("field")).alias("fields"))
    rows = items.join(F.broadcast(priority), key, "left").withColumn("priority", F.coalesce("priority", F.lit("P1")))
    return rows.orderBy("priority", key) if n is None else rows.orderBy("priority", key).limit(n)


def prf(cases: DataFrame) -> DataFrame:
    """V1. Precision, recall and F1 of cases (gold, pred arrays), for each label and over all (micro)."""
    hit, miss, extra = label_sets(F.col("gold"), F.col("pred"))
    tagged = F.concat(*(_tag(c, k) for c, k in ((hit, "tp"), (miss, "fn"), (extra, "fp"))))
    long = cases.select(F.explode(tagged).alias("x")).select("x.*")
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    each = long.groupBy("label").agg(n("tp"), n("fp"), n("fn"))
    rows = each.unionByName(long.agg(n("tp"), n("fp"), n("fn")).withColumn("label", F.lit("(micro)")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rows.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def _tag(labels: Column, kind: str) -> Column:
    return F.transform(labels, lambda x: F.struct(x.alias("label"), F.lit(kind).alias("kind")))


def exact_rate(cases: DataFrame) -> DataFrame:
    """V2. Cases in all, and the share without a missing or extra label."""
    _, miss, extra = label_sets(F.col("gold"), F.col("pred"))
    return cases.select((F.size(miss) + F.size(extra) == 0).alias("ok")).agg(F.count("*").alias("cases"), F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(0.0)).alias("exact_rate"))


def avg_rank(value: str, partition: Sequence[str]) -> Column:
    """E6. Mean rank of equal values, from 1."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2


def ranks(df: DataFrame, value: str, keys: Sequence[str], out: str, buckets: int = 64, bounds: tuple[float, float] | None = None) -> DataFrame:
    """E6 for any number of rows of a key: equal values are counted, the counts added up within ranges of the key's values that hold as many of them each,
    and the ranges' totals over about `buckets` rows; so no key has to be sorted in one task, however its values lie."""
    ranked = counted_below(df, value, keys, buckets, bounds).withColumn(out, F.col("below") + (F.col("c") + 1) / 2)
    return df.join(ranked.select(*keys, value, out), [*keys, value])


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str], bounds: tuple[float, float] | None = None) -> DataFrame:
    """V3. Rank correlation by key; 0 for fewer than two rows or a constant side. bounds: between which both sides lie about evenly, if that is known."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = ranks(ranks(rows, "x", keys, "rx", bounds=bounds), "y", keys, "ry", bounds=bounds)
    r = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))  # corr() fails on a constant side
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.coalesce(r, F.lit(0.0)), 12).alias("spearman"))


def ablation(scored: DataFrame, variants: Sequence[str], label: str, baseline: str) -> DataFrame:
    """V4. Rank correlation of each variant with the label, and its lift over the baseline."""
    long = scored.select(label, F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).cast("double").alias("score")) for v in variants))).alias("x")).select(label, "x.*")
    rows = spearman(long, "score", label, ["variant"])
    base = rows.where(F.col("variant") == baseline).select(F.col("spearman").alias("base"))
    return rows.crossJoin(F.broadcast(base)).select("variant", "n", "spearman", (F.col("spearman") - F.col("base")).alias("lift"))


def fit_alpha(rows: DataFrame, label: str = "label", low: int = 35, high: int = 75, near: int = 55) -> DataFrame:
    """V5. The blend weight of rule and semantic on a grid of hundredths with the best rank correlation, ties to the nearest .55; with the error of the blend against the label on 0..100."""
    grid = rows.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("percent"))
    blended = rows.crossJoin(F.broadcast(grid)).withColumn("blend", F.round(F.col("percent") * F.col("rule") / 100 + (100 - F.col("percent")) * F.col("semantic") / 100, 6))
    fit = spearman(blended, "blend", label, ["percent"], (0.0, 100.0))
    error = blended.groupBy("percent").agg(F.avg(F.abs(F.col("blend") - F.col(label) * 100)).alias("mae"))
    best = fit.join(error, "percent").orderBy(F.round("spearman", 9).desc(), F.abs(F.col("percent") - near), "percent").limit(1)
    return best.select((F.col("percent") / 100).alias("alpha"), "n", "spearman", "mae")


def group_split(cases: DataFrame, key: str, test: float = 0.2, validation: float = 0.15) -> DataFrame:
    """V6. The split of each group: of the sorted groups the last share is test, that before it validation (one at least each), the rest train. Sizes round half to even.
    Groups are numbered within ranges of their keys, after those of the ranges before."""
    groups = cases.select(F.col(key).alias("group_key")).distinct()
    placed = counted_below(groups, "group_key", ()).select("group_key", (F.col("below") + 1).alias("place"))
    total = groups.agg(F.count("*").alias("g"))
    n_test, n_val = F.greatest(F.lit(1), F.bround(F.col("g") * test)), F.greatest(F.lit(1), F.bround(F.col("g") * validation))
    split = F.when(F.col("place") > F.col("g") - n_test, "test").when(F.col("place") > F.col("g") - n_test - n_val, "validation").otherwise("train")
    return placed.crossJoin(F.broadcast(total)).select(F.col("group_key").alias(key), split.alias("split"))


def split_manifest(cases: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """V6. Cases and groups of each split."""
    return cases.join(split, key).groupBy("split").agg(F.count("*").alias("cases"), F.count_distinct(key).alias("groups"))


def holdout(scored: DataFrame, split: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """V7. Rank correlation within each split."""
    return spearman(scored.join(split, key), x, y, ["split"])


def guardrail_rates(cases: DataFrame) -> DataFrame:
    """V8. From (truth, flagged): false positives among the good, detection among the bad, and the share flagged unknown (null) that is good."""
    bad, flagged = F.col("truth") == 1, F.coalesce("flagged", F.lit(False))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0))
    return cases.agg(ratio(~bad & flagged, ~bad).alias("false_positive_rate"), ratio(bad & flagged, bad).alias("detection_rate"), ratio(F.col("flagged").isNull() & ~bad, F.col("flagged").isNull()).alias("safe_unknown_rate"))


def review_sample(docs: DataFrame, n: int, types: Sequence[str], seed: int = 7) -> DataFrame:
    """V9. n rows (8 to 10) in an order that the seed gives, with the layout types in turn."""
    n = min(max(n, 8), 10)
    first = docs.select("doc_id", F.md5(F.concat_ws("-", F.lit(seed), "doc_id")).alias("h")).orderBy("h", "doc_id").limit(n)
    place = F.row_number().over(Window.orderBy("h", "doc_id"))  # n rows
    return first.withColumn("place", place).select("doc_id", "place", F.element_at(F.array(*map(F.lit, types)), ((F.col("place") - 1) % len(types) + 1).cast("int")).alias("layout"))


def sample_items(items: DataFrame, group: str, focus: str, k: int, exclude: DataFrame, seed: int = 7, key: str = "item_id") -> DataFrame:
    """E11. k items of each group, one of each focus first, in an order that the seed gives; excluded items only where nothing else is left of the group."""
    left = items.join(exclude.select(key).distinct().withColumn("out", F.lit(True)), key, "left").withColumn("out", F.coalesce("out", F.lit(False)))
    left = left.withColumn("h", F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string"))))
    fresh = Window.partitionBy(group)
    left = left.withColumn("any", F.max((~F.col("out")).cast("int")).over(fresh)).where((F.col("any") == 0) | ~F.col("out"))
    turn = F.row_number().over(Window.partitionBy(group, focus).orderBy("h", key))
    place = F.row_number().over(Window.partitionBy(group).orderBy("turn", "h", key))
    return left.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= k).select(group, focus, key, "place")
