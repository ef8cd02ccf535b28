"""Queries over labelled sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from .views import Views, duck

FIELDS = ("quality", "toxic")
LAYOUTS = ("single_column", "two_columns", "table", "scan")


def annot(v: Views):
    return v.v_annot_a.where("doc_id % 17 <> 3"), v.v_annot_b


def diff(v: Views, common_only: bool = True):
    return E.compare_annotations(*annot(v), FIELDS, common_only=common_only)


def cases(v: Views):
    names = lambda q, t: F.array_compact(F.array(F.when(q == 1, "good"), F.when(t == 1, "toxic"), F.lit("text")))
    k = F.col("doc_id")
    return v.labels.select("doc_id", names(F.col("quality"), F.col("toxic")).alias("gold"), names(F.when(k % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")), F.when(k % 11 == 0, F.lit(1)).otherwise(F.col("toxic"))).alias("pred"))


def scored(v: Views):
    rows = v.documents.join(v.labels, "doc_id")
    return rows.select("doc_id", "lang", "source", "quality", "n_chars", F.least(F.col("n_chars") / 50, F.lit(100.0)).alias("rule"), (F.col("doc_id") % 101).cast("double").alias("semantic"), (F.col("n_chars") % 1000).cast("double").alias("primary"))


def items(v: Views):
    return v.conversations.select("conv_id", "role", F.concat_ws("-", "conv_id", "turn").alias("item_id"), "turn")


QUERIES = {
    "c14_compare_annotations": lambda v: diff(v, False),
    "c18_label_sets": lambda v: cases(v).select("doc_id", *E.label_sets(F.col("gold"), F.col("pred"))),
    "c19_adjudicate": lambda v: E.adjudicate(annot(v)[0], diff(v), v.labels.where("doc_id % 14 = 0").select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic")), FIELDS),
    "d19_disagreement_counts": lambda v: E.disagreement_counts(diff(v)),
    "e6_avg_rank": lambda v: scored(v).select("doc_id", E.avg_rank("n_chars", ["lang"]).alias("rank")),
    "e6_ranks": lambda v: E.ranks(scored(v).select("doc_id", "lang", "n_chars"), "n_chars", ["lang"], "rank").select("doc_id", "rank"),
    "e11_sample_items": lambda v: E.sample_items(items(v), "conv_id", "role", 3, items(v).where("turn % 3 = 0")),
    "e16_worksheet": lambda v: E.worksheet(diff(v), v.labels.where("doc_id % 21 = 0").select("doc_id", F.lit("P0").alias("priority"))),
    "v1_prf": lambda v: E.prf(cases(v)),
    "v2_exact_rate": lambda v: E.exact_rate(cases(v)),
    "v3_spearman": lambda v: E.spearman(scored(v), "n_chars", "quality", ["lang"]),
    "v4_ablation": lambda v: E.ablation(scored(v), ("rule", "semantic", "primary"), "quality", "rule"),
    "v5_fit_alpha": lambda v: E.fit_alpha(scored(v), "quality"),
    "v6_group_split": lambda v: E.group_split(v.documents, "source"),
    "v6_split_manifest": lambda v: E.split_manifest(v.documents, E.group_split(v.documents, "source"), "source"),
    "v7_holdout": lambda v: E.holdout(scored(v), E.group_split(v.documents, "source"), "source", "n_chars", "quality"),
    "v8_guardrail_rates": lambda v: E.guardrail_rates(v.labels.select(F.col("toxic").alias("truth"), F.when(F.col("doc_id") % 5 != 0, (F.col("toxic") == 1) | (F.col("doc_id") % 9 == 0)).alias("flagged"))),
    "v9_review_sample": lambda v: E.review_sample(v.documents, 20, LAYOUTS),
}

_A = "SELECT * FROM v_annot_a WHERE doc_id % 17 <> 3"
_DIFF = """
SELECT a.doc_id, f AS field, CAST(x AS VARCHAR) AS annotator_a, CAST(y AS VARCHAR) AS annotator_b FROM (SELECT a.doc_id, unnest(['quality', 'toxic']) AS f, unnest([a.quality, a.toxic]) AS x, unnest([b.quality, b.toxic]) AS y FROM annot a JOIN v_annot_b b USING (doc_id)) a
WHERE x IS DISTINCT FROM y"""
_CASES = """
SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, 'text'], lambda x: x IS NOT NULL) AS gold,
  list_filter([CASE WHEN (CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END) = 1 THEN 'good' END, CASE WHEN doc_id % 11 = 0 OR toxic = 1 THEN 'toxic' END, 'text'], lambda x: x IS NOT NULL) AS pred FROM labels"""
_SETS = "SELECT doc_id, list_sort(list_intersect(gold, pred)) AS hit, list_sort(list_filter(gold, lambda x: NOT list_contains(pred, x))) AS miss, list_sort(list_filter(pred, lambda x: NOT list_contains(gold, x))) AS extra FROM cases"
_SCORED = "SELECT doc_id, lang, source, quality, n_chars, least(n_chars / 50, 100) AS rule, CAST(doc_id % 101 AS DOUBLE) AS semantic, CAST(n_chars % 1000 AS DOUBLE) AS prim FROM documents JOIN labels USING (doc_id)"
_TALLY = "SELECT label, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn FROM (SELECT unnest(hit) AS label, 'tp' AS kind FROM sets UNION ALL SELECT unnest(miss), 'fn' FROM sets UNION ALL SELECT unnest(extra), 'fp' FROM sets) GROUP BY 1"
_SPLIT = """
SELECT source, CASE WHEN place > g - t THEN 'test' WHEN place > g - t - w THEN 'validation' ELSE 'train' END AS split FROM (SELECT source, row_number() OVER (ORDER BY source) AS place, count(*) OVER () AS g, greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS t, greatest(1, round_even(count(*) OVER () * 0.15, 0)) AS w
FROM (SELECT DISTINCT source FROM documents))"""


def rho(source: str, key: str, x: str, y: str) -> str:
    """Rank correlation of x and y by key."""
    mean = lambda c: f"rank() OVER (PARTITION BY {key} ORDER BY {c}) + (count(*) OVER (PARTITION BY {key}, {c}) - 1) / 2"
    return f"SELECT {key}, count(*) AS n, CASE WHEN count(*) < 2 OR min(rx) = max(rx) OR min(ry) = max(ry) THEN 0 ELSE corr(rx, ry) END AS spearman FROM (SELECT *, {mean(x)} AS rx, {mean(y)} AS ry FROM ({source})) GROUP BY {key}"


def sql(text: str) -> str:
    return duck(text, annot=_A, diff=_DIFF, cases=_CASES, sets=_SETS, scored=_SCORED, tally=_TALLY, split_of=_SPLIT)


_BLEND = "SELECT *, round(p * rule / 100 + (100 - p) * semantic / 100, 6) AS blend FROM scored, range(35, 76) g(p)"
SQL = {
    "c14_compare_annotations": sql("SELECT * FROM diff UNION ALL SELECT coalesce(a.doc_id, b.doc_id), CASE WHEN a.doc_id IS NULL THEN 'missing_a' ELSE 'missing_b' END, NULL, NULL FROM annot a FULL JOIN v_annot_b b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL"),
    "c18_label_sets": sql("SELECT * FROM sets"),
    "c19_adjudicate": sql(
        """SELECT a.doc_id, a.quality, a.toxic, CAST(coalesce(b.quality, a.quality) AS VARCHAR) AS b_quality, CAST(coalesce(b.toxic, a.toxic) AS VARCHAR) AS b_toxic, CASE WHEN a.doc_id % 14 = 0 THEN 1 ELSE a.quality END AS gold_quality, a.toxic AS gold_toxic FROM annot a LEFT JOIN v_annot_b b USING (doc_id)"""
    ),
    "d19_disagreement_counts": sql("SELECT field, count(*) AS n FROM diff GROUP BY 1"),
    "e6_avg_rank": sql("SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS rank FROM scored"),
    "e6_ranks": sql("SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS rank FROM scored"),
    "e11_sample_items": """
        SELECT conv_id, role, item_id, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t, h, item_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY h, item_id) AS t FROM (
          SELECT *, max(CAST(turn % 3 <> 0 AS INT)) OVER (PARTITION BY conv_id) AS fresh FROM (SELECT *, conv_id || '-' || turn AS item_id, md5('7-' || conv_id || '-' || turn) AS h FROM conversations)) WHERE fresh = 0 OR turn % 3 <> 0)) WHERE place <= 3""",
    "e16_worksheet": sql("SELECT doc_id, list_sort(list(DISTINCT field)) AS fields, CASE WHEN doc_id % 21 = 0 THEN 'P0' ELSE 'P1' END AS priority FROM diff GROUP BY 1"),
    "v1_prf": sql(
        "SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM (SELECT * FROM tally UNION ALL SELECT '(micro)', sum(tp), sum(fp), sum(fn) FROM tally)"
    ),
    "v2_exact_rate": sql("SELECT count(*) AS cases, avg(CASE WHEN len(miss) + len(extra) = 0 THEN 1.0 ELSE 0 END) AS exact_rate FROM sets"),
    "v3_spearman": sql(rho("SELECT * FROM scored", "lang", "n_chars", "quality")),
    "v4_ablation": sql(
        "SELECT variant, n, spearman, spearman - max(spearman) FILTER (variant = 'rule') OVER () AS lift FROM (" + rho("SELECT quality, 'rule' AS variant, rule AS score FROM scored UNION ALL SELECT quality, 'semantic', semantic FROM scored UNION ALL SELECT quality, 'primary', prim FROM scored", "variant", "score", "quality") + ")"
    ),
    "v5_fit_alpha": sql(f"SELECT p / 100 AS alpha, n, spearman, mae FROM ({rho(_BLEND, 'p', 'blend', 'quality')}) JOIN (SELECT p, avg(abs(blend - quality * 100)) AS mae FROM ({_BLEND}) GROUP BY 1) USING (p) ORDER BY round(spearman, 9) DESC, abs(p - 55), p LIMIT 1"),
    "v6_group_split": sql("SELECT * FROM split_of"),
    "v6_split_manifest": sql("SELECT split, count(*) AS cases, count(DISTINCT source) AS groups FROM documents JOIN split_of USING (source) GROUP BY 1"),
    "v7_holdout": sql(rho("SELECT * FROM scored JOIN split_of USING (source)", "split", "n_chars", "quality")),
    "v8_guardrail_rates": """
        SELECT count(*) FILTER (toxic <> 1 AND flagged) / count(*) FILTER (toxic <> 1) AS false_positive_rate, count(*) FILTER (toxic = 1 AND flagged) / count(*) FILTER (toxic = 1) AS detection_rate, count(*) FILTER (flagged IS NULL AND toxic <> 1) / count(*) FILTER (flagged IS NULL) AS safe_unknown_rate
        FROM (SELECT toxic, CASE WHEN doc_id % 5 <> 0 THEN toxic = 1 OR doc_id % 9 = 0 END AS flagged FROM labels)""",
    "v9_review_sample": "SELECT doc_id, place, ['single_column', 'two_columns', 'table', 'scan'][CAST((place - 1) % 4 + 1 AS INT)] AS layout FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7-' || doc_id), doc_id) AS place FROM documents) WHERE place <= 10",
}
