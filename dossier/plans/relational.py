"""Queries over records, users, batches and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..operators import stats as S
from .views import AS_OF, Views, duck

ORG = 3
TEMPLATES = (("^N-", "open-items"), ("-F$", "finished"))

_STUDENT = f"""
SELECT r.*, u.username, p.school, p.major, p.grade, p.class_name,
  CASE WHEN class_name <> '' THEN class_name WHEN concat_ws(' · ', nullif(major, ''), nullif(grade, '')) <> '' THEN concat_ws(' · ', nullif(major, ''), nullif(grade, '')) ELSE 'unassigned' END AS class
FROM v_record r JOIN v_user u USING (user_id) JOIN v_profile p USING (user_id) WHERE r.organization_id = {ORG} AND u.organization_id = {ORG} AND role = 'user'"""


def sql(text: str, **more: str) -> str:
    return duck(text, student=_STUDENT, **more)


def students(v: Views):
    return R.student_records(v.v_record, v.v_user, v.v_profile, ORG)


def pairs(v: Views):
    """Each record with the version before it, where it has one."""
    r = v.v_record
    before = r.select(F.col("user_id"), (F.col("version_no") + 1).alias("version_no"), F.col("record_id").alias("old"), F.col("root_record_id").alias("old_root"))
    joined = r.where(F.col("organization_id") == ORG).join(before, ["user_id", "version_no"])
    return joined.select(F.col("old").alias("record_id"), F.col("record_id").alias("other_id"), F.col("old_root").alias("root_record_id"), F.col("root_record_id").alias("other_root"))


def roster(v: Views):
    known = v.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("username"), F.concat(F.lit("new-"), "c_mktsegment").alias("class_name"))
    new = v.customer.where("c_custkey % 10 = 1").select((F.col("c_custkey") + 10_000_000).alias("k"), F.concat(F.lit("new-user-"), F.col("c_custkey").cast("string")).alias("username"), F.lit("new-class").alias("class_name"))
    again = known.where("k % 2 = 0").select((F.col("k") + 20_000_000).alias("k"), "username", F.lit(" ").alias("class_name"))
    rows = known.unionByName(new).unionByName(again)
    return rows.select(F.col("k").alias("row_no"), "username", F.lit("").alias("school"), F.lit("").alias("major"), F.when(F.col("k") % 4 == 0, "grade-9").otherwise("").alias("grade"), "class_name")


def tasks(v: Views):
    """Records with a time of last change and a number of requeues."""
    return v.v_record.select("record_id", "status", F.to_timestamp("created_at").alias("updated_at"), (F.col("record_id") % 4).alias("requeues"))


def analysed(v: Views):
    """Documents as analysed cases: those without a label have no score; every 37th fails."""
    k = F.col("doc_id")
    rows = v.documents.select("doc_id", "n_chars").join(v.labels.select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    quality = F.when(F.col("label") == 1, "high").when(F.col("label") == 0, F.when(F.col("n_chars") % 2 == 0, "medium").otherwise("low"))
    return rows.select(k.alias("case_id"), F.col("label").isNotNull().alias("scored"), quality.alias("quality"), F.when(k % 37 == 0, "ValueError").alias("failure"))


QUERIES = {
    "a4_read_table": lambda v: v.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderdate").cast("string").alias("newest")),
    "a10_upsert_records": lambda v: R.upsert_records(
        v.v_record.select("record_id", "status", "total_score"), v.v_record.where("record_id % 2 = 0").select("record_id", F.lit("success").alias("status"), (F.col("record_id") % 101).cast("double").alias("total_score"))
    ),
    "b2_scope": lambda v: R.scope(v.v_record, ORG).select("record_id", "user_id", "status"),
    "b6_teacher_records": lambda v: R.teacher_records(v.v_record, v.v_user, v.v_profile, v.v_issue, ORG),
    "b7_page": lambda v: R.page(v.v_record, "created_at", "record_id", 50, 100).select("record_id", F.col("created_at").cast("string").alias("created_at")),
    "b8_screen_files": lambda v: R.screen_files(v.v_file).select("file_id", "suffix", "status", "reason"),
    "b12_repair_detected_targets": lambda v: R.repair_detected_targets(v.v_record).select("record_id", "target_position", "target_source", "total_score", "repaired"),
    "c1_student_records": lambda v: students(v).select("record_id", "username", "school", "major", "grade", "class_name", "total_score"),
    "c3_user_activity": lambda v: R.user_activity(v.v_user, v.v_record, v.v_batch, ORG),
    "c4_admin_records": lambda v: R.admin_records(v.v_record, v.v_user, v.v_job_profile, ORG).withColumn("created_at", F.col("created_at").cast("string")),
    "c5_orphan_files": lambda v: R.orphan_files(v.v_file, v.v_upload, v.v_report),
    "c5_orphan_counts": lambda v: R.orphan_counts(v.v_file, v.v_upload, v.v_report),
    "c6_releasable_paths": lambda v: R.releasable_paths(v.v_upload, v.v_record.where("version_no > 4").select("record_id")),
    "c7_import_history": lambda v: R.import_history(v.v_record.where("user_id % 2 = 0"), v.v_record.where("user_id % 2 = 1 OR record_id % 3 = 0"), 1).select("record_id", "user_id", "imported_from", "filename"),
    "c7_import_dependents": lambda v: R.import_dependents(
        R.import_history(v.v_record.where("user_id % 2 = 0"), v.v_record.where("user_id % 2 = 1 OR record_id % 3 = 0"), 1), v.v_upload
    ).select("upload_id", "record_id"),
    "c15_overlay": lambda v: R.overlay(v.v_file, v.v_file.where("file_id % 6 = 0").select("file_id", F.concat(F.lit("moved-"), "name").alias("name")), "file_id", ["name"]).select("file_id", "name", "path"),
    "c16_compare_versions": lambda v: R.compare_versions(v.v_score, pairs(v)),
    "c17_task_center": lambda v: R.task_center(v.v_record, v.v_batch, v.v_job_profile),
    "c20_report_center": lambda v: R.report_center(v.v_record, v.v_report, v.v_upload, v.v_job_profile),
    "e2_version_chain": lambda v: R.version_chain(v.v_record, v.v_record.groupBy("root_record_id").agg(F.max("record_id").alias("record_id"))),
    "e3_version_trend": lambda v: R.version_trend(v.v_record),
    "e4_top_positions": lambda v: S.top_positions(students(v)),
    "e7_open_batch": lambda v: R.open_batch(v.v_batch),
    "e8_first_upload": lambda v: R.first_upload(v.v_upload),
    "e9_report_map": lambda v: R.report_map(v.v_report).select("record_id", F.map_keys("reports").alias("formats"), F.map_values("reports").alias("ids")),
    "e19_largest_deltas": lambda v: R.largest_deltas(R.compare_versions(v.v_score, pairs(v))),
    "s6_recover_stale": lambda v: R.recover_stale(tasks(v), F.lit(AS_OF).cast("timestamp")).select("record_id", "action", "status"),
    "w1_import_roster": lambda v: R.import_roster(v.v_user, v.v_profile, roster(v), ORG),
    "w2_copy_presets": lambda v: R.copy_presets(
        v.v_job.where("job_id % 3 = 0").select((F.col("job_id") % 2).alias("owner_id"), F.col("position").alias("name"), "category"), v.v_job.select(F.col("position").alias("name"), F.lit("preset").alias("category")), 1
    ),
    "d1_admin_stats": lambda v: S.admin_stats(v.v_user, v.v_record, v.v_batch, v.v_report, ORG, AS_OF),
    "d2_teacher_summary": lambda v: S.teacher_summary(v.v_record, ORG, AS_OF),
    "d3_score_distribution": lambda v: S.score_distribution(v.v_record, ORG),
    "d4_daily_volume": lambda v: S.daily_volume(v.v_record, AS_OF, ORG, 60).withColumn("day", F.col("day").cast("string")),
    "d5_top_schools": lambda v: S.top_groups(v.v_profile, v.v_user, "school", ORG),
    "d5_top_majors": lambda v: S.top_groups(v.v_profile, v.v_user, "major", ORG),
    "d6_top_job_profiles": lambda v: S.top_job_profiles(v.v_record, v.v_job_profile, ORG),
    "d7_score_by_major": lambda v: S.score_by(students(v), "major"),
    "d7_score_by_class": lambda v: S.score_by(students(v), "class_name", 10),
    "d8_profiles_filled": lambda v: S.profiles_filled(v.v_profile, v.v_user, ORG),
    "d9_common_issues": lambda v: S.common_issues(v.v_record, v.v_issue, ORG),
    "d10_class_panel": lambda v: S.class_panel(students(v)),
    "d10_class_issues": lambda v: S.class_issues(students(v), v.v_issue),
    "d11_class_distribution": lambda v: S.class_distribution(students(v)),
    "d12_training_coverage": lambda v: S.training_coverage(students(v), v.v_issue, "N-O", "BUILDING-1", TEMPLATES),
    "d13_batch_rollup": lambda v: S.batch_rollup(v.v_batch_item),
    "d14_status_summary": lambda v: S.status_summary(v.v_record),
    "d15_text_rates": lambda v: S.text_rates(v.documents),
    "d16_facets": lambda v: S.facets(v.v_job),
    "d17_quality_summary": lambda v: S.quality_summary(analysed(v)),
    "d20_latency_summary": lambda v: S.latency_summary(v.events, "value", "event_type"),
}

_TOP = "SELECT record_id FROM v_record WHERE organization_id = {org} ORDER BY created_at DESC, record_id DESC LIMIT 500".format(org=ORG)
_PAIR = f"SELECT b.record_id, r.record_id AS other_id FROM v_record r JOIN v_record b ON b.user_id = r.user_id AND b.version_no + 1 = r.version_no WHERE r.organization_id = {ORG}"
_DELTA = """
  SELECT record_id, other_id, dimension, coalesce(x.value, 0.0) AS before, coalesce(y.value, 0.0) AS after, coalesce(y.value, 0.0) - coalesce(x.value, 0.0) AS delta
  FROM (SELECT record_id, other_id, dimension FROM pair JOIN v_score USING (record_id) UNION SELECT p.record_id, other_id, dimension FROM pair p JOIN v_score s ON s.record_id = other_id) k
  LEFT JOIN v_score x USING (record_id, dimension) LEFT JOIN (SELECT record_id AS other_id, dimension, value FROM v_score) y USING (other_id, dimension)"""
_GUEST = """
  SELECT g.* FROM v_record g WHERE user_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM v_record o WHERE (o.user_id % 2 = 1 OR o.record_id % 3 = 0)
    AND o.filename = g.filename AND o.created_at = g.created_at AND o.total_score = g.total_score)"""
_ROSTER = """
  SELECT c_custkey AS k, c_name AS username, concat('new-', c_mktsegment) AS class_name FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey + 10000000, concat('new-user-', c_custkey), 'new-class' FROM customer WHERE c_custkey % 10 = 1
  UNION ALL SELECT c_custkey + 20000000, c_name, ' ' FROM customer WHERE c_custkey % 6 = 0"""

SQL = {
    "a4_read_table": "SELECT o_orderstatus, count(*) AS n, CAST(max(o_orderdate) AS VARCHAR) AS newest FROM orders GROUP BY 1",
    "a10_upsert_records": sql(
        "SELECT record_id, CASE WHEN status = 'processing' AND record_id % 2 = 0 THEN 'success' ELSE status END AS status, CASE WHEN status = 'processing' AND record_id % 2 = 0 THEN CAST(record_id % 101 AS DOUBLE) ELSE total_score END AS total_score FROM v_record"
    ),
    "b2_scope": sql(f"SELECT record_id, user_id, status FROM v_record WHERE organization_id = {ORG}"),
    "b6_teacher_records": sql(
        "SELECT record_id, username, coalesce(school, '') AS school, coalesce(major, '') AS major, coalesce(class_name, '') AS class_name, target_position, total_score, r.status, (SELECT count(*) FROM v_issue i WHERE i.record_id = r.record_id) AS issue_count "
        "FROM v_record r JOIN top USING (record_id) JOIN v_user u USING (user_id) LEFT JOIN v_profile p USING (user_id)",
        top=_TOP,
    ),
    "b7_page": sql("SELECT record_id, CAST(created_at AS VARCHAR) AS created_at FROM v_record ORDER BY v_record.created_at DESC, record_id DESC LIMIT 50 OFFSET 100"),
    "b8_screen_files": sql(
        r"SELECT file_id, lower(regexp_extract(name, '\.[^.]+$')) AS suffix, CASE WHEN name LIKE '~$%' OR name LIKE '.%' OR lower(regexp_extract(name, '\.[^.]+$')) NOT IN ('.docx', '.pdf', '.txt') THEN 'skipped' ELSE 'accepted' END AS status, "
        r"CASE WHEN name LIKE '~$%' OR name LIKE '.%' THEN 'temp_file' WHEN lower(regexp_extract(name, '\.[^.]+$')) NOT IN ('.docx', '.pdf', '.txt') THEN 'unsupported_suffix' ELSE '' END AS reason FROM v_file"
    ),
    "b12_repair_detected_targets": sql(
        "SELECT record_id, CASE WHEN hit THEN '' ELSE target_position END AS target_position, CASE WHEN hit THEN 'generic' ELSE target_source END AS target_source, total_score, hit AS repaired "
        "FROM (SELECT *, status = 'success' AND target_source = 'detected' AND job_profile_id IS NULL AS hit FROM v_record)"
    ),
    "c1_student_records": sql("SELECT record_id, username, school, major, grade, class_name, total_score FROM student"),
    "c3_user_activity": sql(
        f"SELECT u.user_id, username, u.role, u.status, count(DISTINCT record_id) AS record_count, count(DISTINCT b.batch_id) AS batch_count FROM v_user u LEFT JOIN v_record r USING (user_id) LEFT JOIN v_batch b ON b.user_id = u.user_id WHERE u.organization_id = {ORG} GROUP BY ALL"
    ),
    "c4_admin_records": sql("SELECT record_id, username, coalesce(name, '') AS profile_name, r.status, total_score, CAST(created_at AS VARCHAR) AS created_at FROM v_record r JOIN top USING (record_id) JOIN v_user u USING (user_id) LEFT JOIN v_job_profile USING (job_profile_id)", top=_TOP),
    "c5_orphan_files": sql("SELECT file_id, name, path FROM v_file WHERE path NOT IN (SELECT stored_path FROM v_upload UNION SELECT stored_path FROM v_report)"),
    "c5_orphan_counts": sql("SELECT count(*) AS scanned, count(*) FILTER (path NOT IN (SELECT stored_path FROM v_upload UNION SELECT stored_path FROM v_report)) AS orphans FROM v_file"),
    "c6_releasable_paths": sql(
        "SELECT DISTINCT stored_path FROM v_upload JOIN v_record USING (record_id) WHERE version_no > 4 AND stored_path NOT IN (SELECT stored_path FROM v_upload WHERE record_id NOT IN (SELECT record_id FROM v_record WHERE version_no > 4))"
    ),
    "c7_import_history": sql("SELECT record_id, CAST(1 AS BIGINT) AS user_id, record_id AS imported_from, filename FROM guest", guest=_GUEST),
    "c7_import_dependents": sql("SELECT upload_id, record_id FROM v_upload WHERE record_id IN (SELECT record_id FROM guest)", guest=_GUEST),
    "c15_overlay": sql("SELECT file_id, CASE WHEN file_id % 6 = 0 THEN concat('moved-', name) ELSE name END AS name, path FROM v_file"),
    "c16_compare_versions": sql("SELECT *, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'same' END AS direction FROM change", pair=_PAIR, change=_DELTA),
    "c17_task_center": sql(
        "SELECT 'single' AS kind, record_id AS task_id, filename, status, coalesce(name, '') AS profile FROM (SELECT * FROM v_record WHERE batch_id IS NULL ORDER BY record_id DESC LIMIT 100) LEFT JOIN v_job_profile USING (job_profile_id) "
        "UNION ALL SELECT 'batch', batch_id, filename, status, '' FROM (SELECT * FROM v_batch ORDER BY batch_id DESC LIMIT 100)"
    ),
    "c20_report_center": sql(
        "SELECT r.record_id, status, pdf, docx, coalesce(source, '') AS source, coalesce(name, '') AS profile FROM v_record r LEFT JOIN (SELECT record_id, max(report_id) FILTER (format = 'pdf') AS pdf, max(report_id) FILTER (format = 'docx') AS docx FROM v_report GROUP BY 1) p USING (record_id) "
        "LEFT JOIN (SELECT record_id, arg_min(stored_path, upload_id) AS source FROM v_upload GROUP BY 1) u USING (record_id) LEFT JOIN v_job_profile USING (job_profile_id) WHERE status = 'success' OR pdf IS NOT NULL OR docx IS NOT NULL"
    ),
    "e2_version_chain": sql(
        "SELECT root_record_id AS root, record_id, version_no, row_number() OVER (PARTITION BY root_record_id ORDER BY version_no, record_id) AS place, record_id = max(record_id) OVER (PARTITION BY root_record_id) AS is_current FROM v_record"
    ),
    "e3_version_trend": sql(
        "SELECT *, CASE WHEN delta IS NULL THEN 'first' WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'same' END AS trend FROM (SELECT record_id, version_no, total_score, total_score - lag(total_score) OVER (PARTITION BY root_record_id ORDER BY version_no) AS delta FROM v_record)"
    ),
    "e4_top_positions": sql(
        "SELECT * FROM (SELECT class, target_position, n, row_number() OVER (PARTITION BY class ORDER BY n DESC, target_position) AS place FROM (SELECT class, target_position, count(*) AS n FROM student GROUP BY ALL)) WHERE place <= 3"
    ),
    "e7_open_batch": sql("SELECT user_id, max(batch_id) AS batch_id FROM v_batch WHERE status = 'processing' GROUP BY 1"),
    "e8_first_upload": sql("SELECT record_id, min(upload_id) AS upload_id, arg_min(stored_path, upload_id) AS stored_path FROM v_upload GROUP BY 1"),
    "e9_report_map": sql("SELECT record_id, list(format ORDER BY format) AS formats, list(id ORDER BY format) AS ids FROM (SELECT record_id, format, max(report_id) AS id FROM v_report GROUP BY ALL) GROUP BY 1"),
    "e19_largest_deltas": sql("SELECT *, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'same' END AS direction FROM change ORDER BY abs(delta) DESC, record_id, other_id, dimension LIMIT 100", pair=_PAIR, change=_DELTA),
    "s6_recover_stale": sql(
        f"SELECT record_id, action, CASE action WHEN 'fail' THEN 'failed' WHEN 'requeue' THEN 'pending' ELSE status END AS status FROM (SELECT *, CASE WHEN status = 'processing' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 75 SECOND THEN CASE WHEN record_id % 4 >= 2 THEN 'fail' ELSE 'requeue' END ELSE 'keep' END AS action FROM v_record)"
    ),
    "w1_import_roster": sql(
        f"""SELECT username, action, '' || reason AS reason, CASE WHEN action <> 'skip' THEN coalesce(school, '') END AS school, CASE WHEN action <> 'skip' THEN coalesce(major, '') END AS major,
        CASE WHEN action <> 'skip' THEN coalesce(new_grade, grade, '') END AS grade, CASE WHEN action <> 'skip' THEN coalesce(new_class, class_name, '') END AS class_name
        FROM (SELECT *, CASE WHEN reason <> '' THEN 'skip' WHEN user_id IS NULL THEN 'create' ELSE 'update' END AS action FROM (
          SELECT f.username, new_grade, new_class, u.user_id, school, major, grade, class_name, CASE WHEN organization_id <> {ORG} THEN 'other_tenant' WHEN role <> 'user' THEN 'wrong_role' ELSE '' END AS reason
          FROM (SELECT username, max(CASE WHEN k % 4 = 0 THEN 'grade-9' END) AS new_grade, arg_max(class_name, k) FILTER (trim(class_name) <> '') AS new_class FROM roster GROUP BY 1) f LEFT JOIN v_user u USING (username) LEFT JOIN v_profile p ON p.user_id = u.user_id))""",
        roster=_ROSTER,
    ),
    "w2_copy_presets": sql(
        "SELECT job_id % 2 AS owner_id, position AS name, category FROM v_job WHERE job_id % 3 = 0 UNION ALL SELECT DISTINCT 1, position, 'preset' FROM v_job WHERE position NOT IN (SELECT position FROM v_job WHERE job_id % 3 = 0 AND job_id % 2 = 1)"
    ),
    "d1_admin_stats": sql(
        f"""SELECT count(*) AS users, count(*) FILTER (status = 'active') AS users_active, count(*) FILTER (status = 'disabled') AS users_disabled, count(*) FILTER (role = 'user') AS role_user, count(*) FILTER (role = 'teacher') AS role_teacher, count(*) FILTER (role = 'admin') AS role_admin,
        (SELECT count(*) FROM v_record WHERE organization_id = {ORG}) AS records, (SELECT count(*) FROM v_record WHERE organization_id = {ORG} AND CAST(created_at AS DATE) = DATE '{AS_OF}') AS records_today,
        (SELECT count(*) FROM v_batch WHERE status = 'processing' AND user_id IN (SELECT user_id FROM v_user WHERE organization_id = {ORG})) AS batches_in_flight,
        (SELECT count(*) FROM v_report WHERE record_id IN (SELECT record_id FROM v_record WHERE organization_id = {ORG})) AS reports FROM v_user WHERE organization_id = {ORG}"""
    ),
    "d2_teacher_summary": sql(
        f"SELECT count(*) AS total, count(*) FILTER (CAST(created_at AS DATE) = DATE '{AS_OF}') AS today, count(*) FILTER (CAST(created_at AS DATE) >= DATE '{AS_OF}' - 6) AS week, coalesce(avg(total_score) FILTER (status = 'success'), 0.0) AS average FROM v_record WHERE organization_id = {ORG}"
    ),
    "d3_score_distribution": sql(
        f"SELECT place, band, count(record_id) AS n FROM (VALUES (0, '0-59', -1e9, 60), (1, '60-69', 60, 70), (2, '70-79', 70, 80), (3, '80-89', 80, 90), (4, '90-100', 90, 1e9)) b(place, band, lo, hi) LEFT JOIN v_record ON total_score >= lo AND total_score < hi AND organization_id = {ORG} AND status = 'success' GROUP BY ALL"
    ),
    "d4_daily_volume": sql(f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM v_record WHERE organization_id = {ORG} AND CAST(created_at AS DATE) BETWEEN DATE '{AS_OF}' - 59 AND DATE '{AS_OF}' GROUP BY 1"),
    "d5_top_schools": sql(f"SELECT school AS value, count(*) AS n FROM v_profile JOIN v_user USING (user_id) WHERE organization_id = {ORG} AND school <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 8"),
    "d5_top_majors": sql(f"SELECT major AS value, count(*) AS n FROM v_profile JOIN v_user USING (user_id) WHERE organization_id = {ORG} AND major <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 8"),
    "d6_top_job_profiles": sql(f"SELECT name, count(*) AS n FROM v_record JOIN v_job_profile USING (job_profile_id) WHERE organization_id = {ORG} GROUP BY 1 ORDER BY n DESC, name LIMIT 8"),
    "d7_score_by_major": sql("SELECT major AS value, avg(total_score) AS average, count(*) AS n FROM student WHERE status = 'success' AND major <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 8"),
    "d7_score_by_class": sql("SELECT class_name AS value, avg(total_score) AS average, count(*) AS n FROM student WHERE status = 'success' AND class_name <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 10"),
    "d8_profiles_filled": sql(f"SELECT count(*) FILTER (school <> '' OR major <> '' OR grade <> '') AS filled FROM v_profile JOIN v_user USING (user_id) WHERE organization_id = {ORG}"),
    "d9_common_issues": sql(
        f"SELECT issue, count(*) AS n FROM v_issue WHERE record_id IN (SELECT record_id FROM v_record WHERE organization_id = {ORG} AND status = 'success' ORDER BY record_id DESC LIMIT 200) GROUP BY 1 ORDER BY n DESC, issue LIMIT 8"
    ),
    "d10_class_panel": sql(
        """SELECT class, count(DISTINCT user_id) AS students, count(*) AS records, coalesce(avg(total_score) FILTER (status = 'success'), 0.0) AS average,
        list_sort(list(DISTINCT nullif(major, '')) FILTER (major <> ''))[1:5] AS majors, coalesce(list_sort(list(DISTINCT nullif(grade, '')) FILTER (grade <> ''))[1:5], []) AS grades,
        (SELECT list(target_position ORDER BY place) FROM (SELECT target_position, row_number() OVER (ORDER BY count(*) DESC, target_position) AS place FROM student t WHERE t.class = student.class GROUP BY 1) WHERE place <= 3) AS positions
        FROM student GROUP BY class ORDER BY records DESC, students DESC, class LIMIT 20"""
    ),
    "d10_class_issues": sql(
        "SELECT class, issue, count(*) AS n FROM v_issue JOIN (SELECT record_id, class FROM student ORDER BY record_id LIMIT 300) USING (record_id) WHERE class IN (SELECT class FROM student GROUP BY 1 ORDER BY count(*) DESC, class LIMIT 8) GROUP BY ALL"
    ),
    "d11_class_distribution": sql("SELECT class_name, count(*) AS records, count(DISTINCT user_id) AS students FROM student WHERE class_name <> '' GROUP BY 1 ORDER BY records DESC, class_name LIMIT 10"),
    "d12_training_coverage": sql(
        "SELECT count(*) AS total, count(*) FILTER (hit) AS matched, round(count(*) FILTER (hit) * 100.0 / greatest(count(*), 1), 1) AS percent, 'open-items' AS template FROM (SELECT DISTINCT record_id, record_id IN (SELECT record_id FROM v_issue WHERE contains(issue, 'N-O')) AS hit FROM student WHERE class = 'BUILDING-1')"
    ),
    "d13_batch_rollup": sql(
        """SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS processed,
        CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN CASE WHEN count(*) FILTER (status = 'success') > 0 THEN 'partial_success' ELSE 'failed' END ELSE 'success' END AS status, 100 AS percent FROM v_batch_item GROUP BY 1"""
    ),
    "d14_status_summary": sql("SELECT coalesce(s, status) AS status, count(record_id) AS n FROM (VALUES ('processing'), ('success'), ('failed'), ('paused')) k(s) FULL JOIN v_record ON s = status GROUP BY 1"),
    "d15_text_rates": "SELECT source AS kind, count(*) AS files, count(*) FILTER (length(trim(text)) >= 80) AS readable, count(*) FILTER (length(trim(text)) >= 80) / count(*) AS rate FROM documents GROUP BY 1",
    "d16_facets": sql(
        "SELECT facet, value, count(*) AS n FROM (SELECT unnest([{'facet': 'city', 'value': coalesce(nullif(city, ''), 'none')}, {'facet': 'category', 'value': coalesce(nullif(category, ''), 'none')}, {'facet': 'education', 'value': CASE WHEN regexp_matches(education, 'master|doctor') THEN '硕士' WHEN education = 'bachelor' THEN '本科' WHEN education = 'college' THEN '大专' ELSE '不限' END}], recursive := true) FROM v_job) GROUP BY ALL UNION ALL SELECT unnest(['city', 'category', 'education']), 'all', count(*) FROM v_job"
    ),
    "d17_quality_summary": """WITH c AS (SELECT doc_id AS case_id, quality IS NOT NULL AS scored, doc_id % 37 = 0 AS failed, CASE WHEN quality = 1 THEN 'high' WHEN quality = 0 AND n_chars % 2 = 0 THEN 'medium' WHEN quality = 0 THEN 'low' ELSE 'unknown' END AS q FROM documents LEFT JOIN labels USING (doc_id))
        SELECT *, round(analysed / files, 4) AS analysis_rate, round(passed / files, 4) AS pass_rate, (SELECT list(q || '=' || n ORDER BY q) FROM (SELECT q, count(*) AS n FROM c WHERE NOT failed GROUP BY 1)) AS quality_counts,
        (SELECT list('case-' || case_id || ':ValueError' ORDER BY case_id) FROM (SELECT case_id FROM c WHERE failed ORDER BY 1 LIMIT 20)) AS failure_types
        FROM (SELECT count(*) AS files, count(*) FILTER (scored AND NOT failed) AS analysed, count(*) FILTER (q IN ('high', 'medium') AND NOT failed) AS passed FROM c)""",
    "d20_latency_summary": "SELECT event_type, count(*) AS n, round(avg(v), 2) AS mean, max(v) FILTER (i = round_even((n - 1) * 0.5, 0)) AS p50, max(v) FILTER (i = round_even((n - 1) * 0.95, 0)) AS p95, min(v) AS least, max(v) AS most FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1",
}
