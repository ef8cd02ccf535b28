"""Records, their versions, files and owners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUCCESS, PROCESSING, FAILED = "success", "processing", "failed"
STALE_SECONDS, MOST_REQUEUES = 75, 2


def scope(df: DataFrame, org_id: int | None = None, user_id: int | None = None, *, is_guest: bool = False, session_id: str | None = None, strict_null: bool = False) -> DataFrame:
    """B2. Rows of a tenant and, if given, an owner. A guest sees the rows of its session, and none without one; strict_null keeps members to rows without a session."""
    if org_id is not None:
        df = df.where(F.col("organization_id") == org_id)
    if is_guest:
        return df.where(F.col("guest_session_id") == session_id) if session_id else df.limit(0)
    if user_id is not None:
        df = df.where(F.col("user_id") == user_id)
    return df.where(F.col("guest_session_id").isNull()) if strict_null else df


def page(df: DataFrame, order_col: str, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """B7. Newest first; the limit is held to 1..500."""
    return df.orderBy(F.desc(order_col), F.desc(key)).offset(max(offset, 0)).limit(min(max(limit, 1), 500))


def public_sections(sections: Column) -> Column:
    """B6. A section map without private (_) and empty keys."""
    return F.map_filter(sections, lambda k, v: ~F.startswith(k, F.lit("_")) & (F.size(v) > 0))


def teacher_records(records: DataFrame, users: DataFrame, profiles: DataFrame, issues: DataFrame, org: int, limit: int = 500) -> DataFrame:
    """B6, C2. The newest records of a tenant with owner and profile; counts, never text. A missing profile gives empty strings."""
    newest = page(scope(records, org), "created_at", "record_id", limit)
    counts = issues.join(newest.select("record_id"), "record_id", "left_semi").groupBy("record_id").agg(F.count("*").alias("issue_count"))
    own = profiles.select("user_id", "school", "major", "class_name")
    joined = newest.join(users.select("user_id", "username"), "user_id").join(own, "user_id", "left").join(counts, "record_id", "left")
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("school", "major", "class_name")]
    return joined.select("record_id", "username", *empty, "target_position", "total_score", "status", F.coalesce("issue_count", F.lit(0)).alias("issue_count"))


def repair_detected_targets(records: DataFrame) -> DataFrame:
    """B12. Clears the target of successful records whose target was only detected; scores stay, rows stay. Runs twice as well as once."""
    hit = (F.col("status") == SUCCESS) & (F.col("target_source") == "detected") & F.col("job_profile_id").isNull()
    return records.withColumns({
        "target_position": F.when(hit, F.lit("")).otherwise(F.col("target_position")), "target_source": F.when(hit, F.lit("generic")).otherwise(F.col("target_source")), "repaired": F.coalesce(hit, F.lit(False)),
    })


def student_records(records: DataFrame, users: DataFrame, profiles: DataFrame, org: int) -> DataFrame:
    """C1. Records of a tenant's students with their profiles."""
    students = users.where((F.col("organization_id") == org) & (F.col("role") == "user")).select("user_id", "username")
    return scope(records, org).join(students, "user_id").join(profiles, "user_id")


def user_activity(users: DataFrame, records: DataFrame, batches: DataFrame, org: int) -> DataFrame:
    """C3. Users of a tenant with their numbers of records and batches; zero stays. Children are counted before they are joined."""
    r = records.groupBy("user_id").agg(F.count_distinct("record_id").alias("record_count"))
    b = batches.groupBy("user_id").agg(F.count_distinct("batch_id").alias("batch_count"))
    joined = users.where(F.col("organization_id") == org).join(r, "user_id", "left").join(b, "user_id", "left")
    return joined.select("user_id", "username", "role", "status", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("record_count", "batch_count")))


def admin_records(records: DataFrame, users: DataFrame, job_profiles: DataFrame, org: int, limit: int = 500) -> DataFrame:
    """C4. The newest records of a tenant with owner and profile names; a missing profile is empty."""
    newest = page(scope(records, org), "created_at", "record_id", limit)
    names = job_profiles.select("job_profile_id", F.col("name").alias("profile_name"))
    joined = newest.join(users.select("user_id", "username"), "user_id").join(names, "job_profile_id", "left")
    return joined.select("record_id", "username", F.coalesce("profile_name", F.lit("")).alias("profile_name"), "status", "total_score", "created_at")


def orphan_files(files: DataFrame, uploads: DataFrame, reports: DataFrame) -> DataFrame:
    """C5. Files that no upload and no report refers to."""
    used = uploads.select(F.col("stored_path").alias("path")).unionByName(reports.select(F.col("stored_path").alias("path")))
    return files.join(used, "path", "left_anti").select("file_id", "name", "path")


def orphan_counts(files: DataFrame, uploads: DataFrame, reports: DataFrame) -> DataFrame:
    """C5. Files scanned and orphaned."""
    orphans = orphan_files(files, uploads, reports).agg(F.count("*").alias("orphans"))
    return files.agg(F.count("*").alias("scanned")).crossJoin(orphans)


def releasable_paths(refs: DataFrame, deleted: DataFrame) -> DataFrame:
    """C6. Paths of deleted records that no surviving row refers to."""
    gone = refs.join(deleted, "record_id", "left_semi").select("stored_path").distinct()
    kept = refs.join(deleted, "record_id", "left_anti").select("stored_path")
    return gone.join(kept, "stored_path", "left_anti")


def import_history(guest: DataFrame, owned: DataFrame, owner: int) -> DataFrame:
    """C7. Guest rows that the owner does not have yet, as the owner's; rows are the same if file, time and score are."""
    same = ["filename", "created_at", "total_score"]
    new = guest.join(owned.select(*same), same, "left_anti")
    return new.withColumn("user_id", F.lit(owner).cast(guest.schema["user_id"].dataType)).withColumn("imported_from", F.col("record_id"))


def import_dependents(imported: DataFrame, children: DataFrame) -> DataFrame:
    """C7. Uploads or reports of the imported rows."""
    return children.join(imported.select(F.col("imported_from").alias("record_id")), "record_id", "left_semi")


def compare_versions(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """C16. For pairs (record_id, other_id, root_record_id, other_root) of one root: each dimension of either with both values, delta and direction."""
    pairs = pairs.where(F.coalesce("root_record_id", "record_id") == F.coalesce("other_root", "other_id")).select("record_id", "other_id")
    left = pairs.join(scores, "record_id").select("record_id", "other_id", "dimension", F.col("value").alias("before"))
    right = pairs.join(scores.withColumnRenamed("record_id", "other_id"), "other_id").select("record_id", "other_id", "dimension", F.col("value").alias("after"))
    both = left.join(right, ["record_id", "other_id", "dimension"], "full").fillna(0.0, ["before", "after"])
    delta = F.col("after") - F.col("before")
    return both.withColumn("delta", delta).withColumn("direction", F.when(delta > 0, "up").when(delta < 0, "down").otherwise("same"))


def largest_deltas(deltas: DataFrame, n: int = 100) -> DataFrame:
    """E19. Deltas by absolute change."""
    return deltas.orderBy(F.abs("delta").desc(), "record_id", "other_id", "dimension").limit(n)


def task_center(records: DataFrame, batches: DataFrame, profiles: DataFrame, n: int = 100) -> DataFrame:
    """C17. The newest single records and batches in one list."""
    names = profiles.select("job_profile_id", F.col("name").alias("profile"))
    singles = records.where(F.col("batch_id").isNull()).orderBy(F.desc("record_id")).limit(n).join(names, "job_profile_id", "left")
    one = singles.select(F.lit("single").alias("kind"), F.col("record_id").alias("task_id"), "filename", "status", F.coalesce("profile", F.lit("")).alias("profile"))
    many = batches.orderBy(F.desc("batch_id")).limit(n).select(F.lit("batch").alias("kind"), F.col("batch_id").alias("task_id"), "filename", "status", F.lit("").alias("profile"))
    return one.unionByName(many).orderBy(F.desc("task_id"), "kind")


def version_chain(records: DataFrame, current: DataFrame) -> DataFrame:
    """E2. All versions of each chain in order; the current ones are flagged. A row without a root is its own."""
    flagged = records.join(current.select("record_id").withColumn("is_current", F.lit(True)), "record_id", "left")
    w = Window.partitionBy("root").orderBy("version_no", "created_at", "record_id")
    rows = flagged.withColumn("root", F.coalesce("root_record_id", "record_id"))
    return rows.select("root", "record_id", "version_no", F.row_number().over(w).alias("place"), F.coalesce("is_current", F.lit(False)).alias("is_current"))


def version_trend(records: DataFrame) -> DataFrame:
    """E3. Change of the score against the version before."""
    w = Window.partitionBy(F.coalesce("root_record_id", "record_id")).orderBy("version_no", "record_id")
    delta = F.col("total_score") - F.lag("total_score").over(w)
    rows = records.select("record_id", "version_no", "total_score", delta.alias("delta"))
    return rows.withColumn("trend", F.when(F.col("delta").isNull(), "first").when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("same"))


def open_batch(batches: DataFrame) -> DataFrame:
    """E7. The newest unfinished batch of each owner."""
    unfinished = batches.where(F.col("status").isin("pending", "processing", "paused"))
    return unfinished.groupBy("user_id").agg(F.max("batch_id").alias("batch_id"))


def first_upload(uploads: DataFrame) -> DataFrame:
    """E8. The earliest upload of each record."""
    return uploads.groupBy("record_id").agg(F.min("upload_id").alias("upload_id"), F.min_by("stored_path", "upload_id").alias("stored_path"))


def report_map(reports: DataFrame) -> DataFrame:
    """E9. The last report of each format by record, as a map."""
    last = reports.groupBy("record_id", "format").agg(F.max("report_id").alias("report_id"))
    return last.groupBy("record_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("format", "report_id")))).alias("reports"))


def report_center(records: DataFrame, reports: DataFrame, uploads: DataFrame, profiles: DataFrame) -> DataFrame:
    """C20. Records that succeeded or have a report, with their last reports, first upload and profile."""
    names = profiles.select("job_profile_id", F.col("name").alias("profile"))
    joined = records.join(report_map(reports), "record_id", "left").join(first_upload(uploads), "record_id", "left").join(names, "job_profile_id", "left")
    kept = joined.where((F.col("status") == SUCCESS) | F.col("reports").isNotNull())
    return kept.select(
        "record_id", "status", F.element_at(F.col("reports"), "pdf").alias("pdf"), F.element_at(F.col("reports"), "docx").alias("docx"), F.coalesce("stored_path", F.lit("")).alias("source"), F.coalesce("profile", F.lit("")).alias("profile")
    )


def upsert_records(current: DataFrame, updates: DataFrame, key: str = "record_id", columns: Sequence[str] = ("status", "total_score"), order: str | None = None) -> DataFrame:
    """A10. The new snapshot: an update takes effect while its record is processing. Of several updates for a key the last by `order` counts; without one any row that sorts last."""
    new = F.struct(*columns)
    last = updates.groupBy(key).agg((F.max_by(new, order) if order else F.max(new)).alias("new"))
    joined = current.join(last, key, "left")
    applies = (F.col("status") == PROCESSING) & F.col("new").isNotNull()
    return joined.select(*(F.when(applies, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns))


def recover_stale(tasks: DataFrame, as_of: Column, seconds: int = STALE_SECONDS, most: int = MOST_REQUEUES) -> DataFrame:
    """S6. What becomes of each task: processing for longer than `seconds` is queued again, and fails the time after `most`."""
    stale = (F.col("status") == PROCESSING) & (F.col("updated_at") < as_of - F.make_dt_interval(secs=F.lit(seconds)))
    action = F.when(stale & (F.col("requeues") >= most), "fail").when(stale, "requeue").otherwise("keep")
    return tasks.withColumn("action", action).withColumn("status", F.when(F.col("action") == "fail", FAILED).when(F.col("action") == "requeue", "pending").otherwise(F.col("status")))


def import_roster(users: DataFrame, profiles: DataFrame, rows: DataFrame, org: int, create_missing: bool = True) -> DataFrame:
    """W1. What becomes of each roster row: skip, update or create, and why; updates carry the non-blank fields over the profile's.

    Of several rows for a name the last non-blank value of each field in file order (row_no) counts.
    """
    fields = ("school", "major", "grade", "class_name")
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    key = F.trim("username")
    blank = rows.where(F.coalesce(key, F.lit("")) == "").select(F.lit("").alias("username"), F.lit("skip").alias("action"), F.lit("blank_key").alias("reason"), *(F.lit(None).cast("string").alias(f) for f in fields))
    folded = rows.where(key != "").groupBy(key.alias("username")).agg(*(F.max_by(filled(f), F.when(filled(f).isNotNull(), F.col("row_no"))).alias(f"new_{f}") for f in fields))
    known = users.select("username", "user_id", "organization_id", "role").join(profiles.select("user_id", *fields), "user_id", "left")
    joined = folded.join(known, "username", "left")
    found = F.col("user_id").isNotNull()
    reason = (
        F.when(found & (F.col("organization_id") != org), "other_tenant").when(found & (F.col("role") != "user"), "wrong_role").when(~found & ~F.lit(create_missing), "not_found").otherwise("")
    )
    action = F.when(F.col("reason") != "", "skip").when(found, "update").otherwise("create")
    judged = joined.withColumn("reason", reason).withColumn("action", action)
    values = [F.when(F.col("action") != "skip", F.coalesce(f"new_{f}", f, F.lit(""))).alias(f) for f in fields]
    return judged.select("username", "action", "reason", *values).unionByName(blank)


def copy_presets(library: DataFrame, presets: DataFrame, owner: int) -> DataFrame:
    """W2. The library with those presets that the owner lacks by name; a second run adds none."""
    own = library.where(F.col("owner_id") == owner).select("name")
    return library.unionByName(presets.join(own, "name", "left_anti").dropDuplicates(["name"]).select(F.lit(owner).cast(library.schema["owner_id"].dataType).alias("owner_id"), "name", "category"))


def screen_files(files: DataFrame, allowed: Sequence[str] = (".docx", ".pdf", ".txt")) -> DataFrame:
    """B8. Accepted or skipped, and why: temporary files and suffixes that are not allowed."""
    suffix = F.lower(F.regexp_extract("name", r"\.[^.]+$", 0))
    reason = F.when(F.startswith("name", F.lit("~$")) | F.startswith("name", F.lit(".")), "temp_file").when(~suffix.isin(*allowed), "unsupported_suffix").otherwise("")
    return files.withColumn("suffix", suffix).withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "accepted").otherwise("skipped"))


def overlay(rows: DataFrame, manifest: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """C15. Columns replaced where the manifest has the key and a value."""
    new = manifest.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    joined = rows.join(new, key, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))
