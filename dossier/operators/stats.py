"""Counts and rates for tenants, classes and batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = ((0, 60, "0-59"), (60, 70, "60-69"), (70, 80, "70-79"), (80, 90, "80-89"), (90, None, "90-100"))
RECORD_STATUSES = ("processing", "success", "failed", "paused")
UNASSIGNED = "unassigned"


def admin_stats(users: DataFrame, records: DataFrame, batches: DataFrame, reports: DataFrame, org: int, as_of: str) -> DataFrame:
    """D1. One row of counts for a tenant: users by status and role, records in all and of the day, batches in flight, reports."""
    u = users.where(F.col("organization_id") == org)
    r = records.where(F.col("organization_id") == org)
    one = u.agg(
        F.count("*").alias("users"), *(F.count_if(F.col("status") == s).alias(f"users_{s}") for s in ("active", "disabled")), *(F.count_if(F.col("role") == x).alias(f"role_{x}") for x in ("user", "teacher", "admin"))
    )
    two = r.agg(F.count("*").alias("records"), F.count_if(F.to_date("created_at") == F.lit(as_of).cast("date")).alias("records_today"))
    three = batches.join(u.select("user_id"), "user_id", "left_semi").agg(F.count_if(F.col("status").isin("pending", "processing")).alias("batches_in_flight"))
    four = reports.join(r.select("record_id"), "record_id", "left_semi").agg(F.count("*").alias("reports"))
    return reduce(DataFrame.crossJoin, (one, two, three, four))


def teacher_summary(records: DataFrame, org: int, as_of: str) -> DataFrame:
    """D2. Records in all, of the day and of the last seven days, and the mean score of the successes."""
    day, today = F.to_date("created_at"), F.lit(as_of).cast("date")
    return records.where(F.col("organization_id") == org).agg(
        F.count("*").alias("total"), F.count_if(day == today).alias("today"), F.count_if(day >= F.date_sub(today, 6)).alias("week"), F.coalesce(F.avg(F.when(F.col("status") == "success", F.col("total_score"))), F.lit(0.0)).alias("average")
    )


def band(score: Column) -> Column:
    out = F.lit(BANDS[-1][2])
    for _, upper, name in reversed(BANDS[:-1]):
        out = F.when(score < upper, name).otherwise(out)
    return out


def score_distribution(records: DataFrame, org: int) -> DataFrame:
    """D3. Successes by score band; empty bands are 0, in fixed order."""
    spark = records.sparkSession
    counts = records.where((F.col("organization_id") == org) & (F.col("status") == "success")).groupBy(band(F.col("total_score")).alias("band")).agg(F.count("*").alias("n"))
    bands = spark.createDataFrame([(i, b[2]) for i, b in enumerate(BANDS)], "place int, band string")
    return bands.join(counts, "band", "left").select("place", "band", F.coalesce("n", F.lit(0)).alias("n")).orderBy("place")


def daily_volume(records: DataFrame, as_of: str, org: int, days: int = 7) -> DataFrame:
    """D4. Records of each of the last days that has any."""
    day, today = F.to_date("created_at"), F.lit(as_of).cast("date")
    kept = records.where((F.col("organization_id") == org) & day.between(F.date_sub(today, days - 1), today))
    return kept.groupBy(day.alias("day")).agg(F.count("*").alias("n")).orderBy("day")


def top_groups(profiles: DataFrame, users: DataFrame, col: str, org: int, n: int = 8) -> DataFrame:
    """D5. The largest groups of a profile column; blanks are left out, ties by name."""
    own = profiles.join(users.where(F.col("organization_id") == org).select("user_id"), "user_id", "left_semi")
    return own.where(F.col(col) != "").groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def top_job_profiles(records: DataFrame, profiles: DataFrame, org: int, n: int = 8) -> DataFrame:
    """D6. Job profiles by number of records."""
    counts = records.where(F.col("organization_id") == org).groupBy("job_profile_id").agg(F.count("*").alias("n"))
    return counts.join(profiles, "job_profile_id").select("name", "n").orderBy(F.desc("n"), "name").limit(n)


def score_by(students: DataFrame, col: str, n: int = 8) -> DataFrame:
    """D7. Mean score and number of successes by a profile column."""
    kept = students.where((F.col("status") == "success") & (F.col(col) != ""))
    return kept.groupBy(F.col(col).alias("value")).agg(F.avg("total_score").alias("average"), F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def profiles_filled(profiles: DataFrame, users: DataFrame, org: int) -> DataFrame:
    """D8. Profiles with school, major or grade."""
    own = profiles.join(users.where(F.col("organization_id") == org).select("user_id"), "user_id", "left_semi")
    return own.agg(F.count_if((F.col("school") != "") | (F.col("major") != "") | (F.col("grade") != "")).alias("filled"))


def common_issues(records: DataFrame, issues: DataFrame, org: int, recent: int = 200, n: int = 8) -> DataFrame:
    """D9. The most frequent issues of the newest successes."""
    newest = records.where((F.col("organization_id") == org) & (F.col("status") == "success")).orderBy(F.desc("record_id")).limit(recent).select("record_id")
    found = issues.join(newest, "record_id", "left_semi").where(F.trim("issue") != "")
    return found.groupBy(F.trim("issue").alias("issue")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(n)


def class_label() -> Column:
    """D11. The class, else major · grade, else unassigned."""
    rest = F.concat_ws(" · ", F.nullif("major", F.lit("")), F.nullif("grade", F.lit("")))
    return F.when(F.col("class_name") != "", F.col("class_name")).when(rest != "", rest).otherwise(UNASSIGNED)


def class_distribution(students: DataFrame, n: int = 10) -> DataFrame:
    """D11. Records and students by explicit class."""
    kept = students.where(F.col("class_name") != "")
    return kept.groupBy("class_name").agg(F.count("*").alias("records"), F.count_distinct("user_id").alias("students")).orderBy(F.desc("records"), "class_name").limit(n)


def top_positions(students: DataFrame, n: int = 3) -> DataFrame:
    """E4. The most frequent positions of each class."""
    counts = students.where(F.col("target_position") != "").groupBy(class_label().alias("class"), "target_position").agg(F.count("*").alias("n"))
    w = Window.partitionBy("class").orderBy(F.desc("n"), "target_position")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def class_panel(students: DataFrame, n: int = 20) -> DataFrame:
    """D10. Classes with students, records, mean score, first five majors and grades, and top three positions."""
    rows = students.withColumn("class", class_label())
    first = lambda c: F.slice(F.array_sort(F.collect_set(F.nullif(c, F.lit("")))), 1, 5)
    totals = rows.groupBy("class").agg(
        F.count_distinct("user_id").alias("students"), F.count("*").alias("records"), F.coalesce(F.avg(F.when(F.col("status") == "success", F.col("total_score"))), F.lit(0.0)).alias("average"),
        first("major").alias("majors"), first("grade").alias("grades"),
    )
    tops = top_positions(students).groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "target_position"))), lambda x: x["target_position"]).alias("positions"))
    best = totals.orderBy(F.desc("records"), F.desc("students"), "class").limit(n)
    return best.join(tops, "class", "left")


def class_issues(students: DataFrame, issues: DataFrame, rows: int = 300, classes: int = 8) -> DataFrame:
    """D10. Issue counts of the first rows (by record id) of the classes with most records."""
    labelled = students.select("record_id", class_label().alias("class"))
    top = labelled.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(classes).select("class")
    first = labelled.orderBy("record_id").limit(rows).join(top, "class", "left_semi")
    return issues.join(first, "record_id").groupBy("class", "issue").agg(F.count("*").alias("n"))


def training_coverage(students: DataFrame, issues: DataFrame, issue: str, class_name: str, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """D12. Records of a class whose issues hold the text, against all, in percent; and the first training template whose pattern the issue meets."""
    rows = students.where(class_label() == class_name).select("record_id").distinct()
    hit = issues.where(F.contains("issue", F.lit(issue))).select("record_id").distinct().withColumn("hit", F.lit(1))
    template = F.lit("general")
    for pattern, name in reversed(templates):
        template = F.when(F.lit(issue).rlike(pattern), name).otherwise(template)
    counted = rows.join(hit, "record_id", "left").agg(F.count("*").alias("total"), F.count("hit").alias("matched"))
    return counted.select("total", "matched", F.round(F.col("matched") * 100.0 / F.greatest("total", F.lit(1)), 1).alias("percent"), template.alias("template"))


def final_status(success: Column, failed: Column) -> Column:
    return F.when((failed > 0) & (success > 0), "partial_success").when(failed > 0, "failed").otherwise("success")


def batch_rollup(items: DataFrame) -> DataFrame:
    """D13. Of each batch its counts by status, its final status and the percentage done."""
    n = lambda s: F.count_if(F.col("status") == s)
    rows = items.groupBy("batch_id").agg(F.count("*").alias("total"), n("success").alias("success"), n("failed").alias("failed"), n("skipped").alias("skipped"))
    done = F.col("success") + F.col("failed") + F.col("skipped")
    return rows.select("*", done.alias("processed"), final_status(F.col("success"), F.col("failed")).alias("status"), F.floor(done * 100 / F.greatest("total", F.lit(1))).alias("percent"))


def status_summary(tasks: DataFrame, known: tuple[str, ...] = RECORD_STATUSES) -> DataFrame:
    """D14. Tasks by status; known statuses without tasks are 0, unknown ones stay."""
    all_ = tasks.sparkSession.createDataFrame([(s,) for s in known], "status string")
    counts = tasks.groupBy("status").agg(F.count("*").alias("n"))
    return counts.join(all_, "status", "full").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def text_rates(docs: DataFrame, kind: str = "source") -> DataFrame:
    """D15. Files by type, and the share with readable text."""
    readable = F.length(F.trim("text")) >= 80
    return docs.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("files"), F.count_if(readable).alias("readable")).withColumn("rate", F.col("readable") / F.col("files"))


#: Degrees that postings ask for, in the order in which they are looked for, and the words for each; blank and all else: the last.
DEGREE_BUCKETS = (("硕士", "硕士|研究生|博士|master|doctor"), ("本科", "本科|学士|bachelor"), ("大专", "大专|专科|高职|college"), ("中专", "中专|中技"))
ANY_DEGREE = "不限"


def degree_bucket(c: Column) -> Column:
    """D16. The first degree whose words a text holds, else any degree (null and blank too)."""
    return F.coalesce(*(F.when(c.rlike(words), F.lit(name)) for name, words in DEGREE_BUCKETS), F.lit(ANY_DEGREE))


def facets(jobs: DataFrame, columns: tuple[str, ...] = ("city", "category"), degree: str = "education", blank: str = "none") -> DataFrame:
    """D16. Counts by value of each facet and by degree, with a row for all; blank and null values count as `blank`."""
    value = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(blank))
    pairs = [F.struct(F.lit(c).alias("facet"), value(c).alias("value")) for c in columns] + [F.struct(F.lit(degree).alias("facet"), degree_bucket(F.col(degree)).alias("value"))]
    counts = jobs.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").groupBy("facet", "value").agg(F.count("*").alias("n"))
    total = jobs.agg(F.count("*").alias("n")).select(F.explode(F.array(*map(F.lit, (*columns, degree)))).alias("facet"), F.lit("all").alias("value"), "n")
    return counts.unionByName(total).orderBy("facet", F.desc("n"), "value")


def quality_summary(results: DataFrame, most_failures: int = 20) -> DataFrame:
    """D17. results: (case_id, scored, quality, failure). One row: files, analysed, passed (high or medium), both rates, files by quality
    (null: unknown; failed ones have none), and the first failures by case_id as case-<id>:<failure>. Without rows the rates are 0."""
    ok = F.col("failure").isNull()
    by_quality = results.where(ok).groupBy(F.coalesce("quality", F.lit("unknown")).alias("quality")).agg(F.count("*").alias("n"))
    counts = by_quality.agg(F.array_sort(F.collect_list(F.concat_ws("=", "quality", "n"))).alias("quality_counts"))
    failed = results.where(~ok).orderBy("case_id").limit(most_failures).agg(F.array_sort(F.collect_list(F.struct("case_id", "failure"))).alias("f"))
    codes = failed.select(F.transform("f", lambda x: F.concat(F.lit("case-"), x["case_id"].cast("string"), F.lit(":"), x["failure"])).alias("failure_types"))
    whole = results.agg(F.count("*").alias("files"), F.count_if(ok & F.col("scored")).alias("analysed"), F.count_if(ok & F.col("quality").isin("high", "medium")).alias("passed"))
    rate = lambda c: F.coalesce(F.round(F.try_divide(c, "files"), 4), F.lit(0.0))
    return whole.withColumns({"analysis_rate": rate("analysed"), "pass_rate": rate("passed")}).crossJoin(counts).crossJoin(codes)  # one row each


def latency_summary(df: DataFrame, value: str, key: str) -> DataFrame:
    """D20. Count, mean, nearest-rank p50 and p95 (index round((n - 1) q)), least and most, by key; exact. No key is sorted in one task."""
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("v"))
    whole = rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("v"), 2).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))
    placed = counted_below(rows, "v", [key]).join(whole.select(key, "n"), key)
    index = lambda q: F.bround((F.col("n") - 1) * q)
    at = lambda q: F.max(F.when((F.col("below") <= index(q)) & (index(q) < F.col("below") + F.col("c")), F.col("v")))
    found = placed.groupBy(key).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    return whole.join(found, key).select(key, "n", "mean", "p50", "p95", "least", "most")


def in_ranges(values: DataFrame, value: str, keys: Sequence[str] = (), buckets: int = 64, sample: int = 8) -> DataFrame:
    """values, which are distinct within each key, with bucket: ranges in order of value that hold about as many values each, whatever their distribution. Their ends are those of
    a sample of each key's values, about `buckets * sample` told by their hashes, so that they are the same wherever they are computed. A null sorts first."""
    # of n values those whose hash is in the lowest `buckets * sample` nths: about so many, all if there are no more
    n = values.groupBy(*keys).agg(F.count("*").alias("n"))
    sized = values.select(*keys, value).join(n, list(keys)) if keys else values.select(value).crossJoin(F.broadcast(n))
    chosen = sized.where((F.pmod(F.xxhash64(value), F.lit(1 << 20)) * F.col("n") < (buckets * sample << 20)) & F.col(value).isNotNull())
    found = chosen.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("chosen"))
    step = F.greatest(F.floor(F.size("chosen") / buckets), F.lit(1))
    ends = found.withColumn("step", step).select(*keys, F.filter("chosen", lambda x, i: i % F.col("step") == F.col("step") - 1).alias("ends"))
    # first among every eighth end, then among the eight that follow
    ends = ends.withColumn("coarse", F.filter("ends", lambda x, i: i % 8 == 7))
    joined = values.join(ends, list(keys), "left") if keys else values.crossJoin(F.broadcast(ends))
    below = lambda c: F.coalesce(F.size(F.filter(c, lambda e: e < F.col(value))), F.lit(0))
    joined = joined.withColumn("eighths", below("coarse")).withColumn("next", F.slice("ends", F.col("eighths") * 8 + 1, F.lit(8)))
    return joined.withColumn("bucket", F.col("eighths") * 8 + below("next")).drop("ends", "coarse", "eighths", "next")


def counted_below(df: DataFrame, value: str, keys: Sequence[str], buckets: int = 64, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Distinct values of each key, with c, their rows, and below, the key's rows of smaller values. Equal values are counted first; the counts are
    added up within in_ranges() of a key's values, and the ranges' totals over as many rows as there are ranges. With `bounds`, between which values lie about evenly, ranges are
    equal parts of these, and no sample is taken."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    if bounds:
        part = F.floor((F.col(value) - bounds[0]) / (bounds[1] - bounds[0]) * buckets)
        counts = counts.withColumn("bucket", F.coalesce(F.least(F.greatest(part, F.lit(0)), F.lit(buckets - 1)), F.lit(0)))
    else:
        counts = in_ranges(counts, value, keys, buckets)
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*keys, "bucket").agg(F.sum("c").alias("t")).withColumn("start", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    w = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(totals, [*keys, "bucket"]).select(*keys, value, "c", (F.col("start") + F.coalesce(F.sum("c").over(w), F.lit(0))).alias("below"))
