"""Views over the given tables. One text serves Spark and DuckDB; where the two differ there are two."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
AS_OF = "2001-08-01"

VIEWS = {
    "v_org": "SELECT n_nationkey AS organization_id, n_name AS name FROM {nation}",
    "v_user": """
        SELECT c_custkey AS user_id, c_nationkey AS organization_id, c_name AS username,
               CASE WHEN c_custkey % 97 = 0 THEN 'admin' WHEN c_custkey % 50 = 0 THEN 'teacher' ELSE 'user' END AS role,
               CASE WHEN c_acctbal < 0 THEN 'disabled' ELSE 'active' END AS status FROM {customer}""",
    "v_profile": """
        SELECT c_custkey AS user_id,
               CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat('school-', CAST(c_custkey % 12 AS STRING)) END AS school,
               c_mktsegment AS major,
               CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('grade-', CAST(c_custkey % 4 AS STRING)) END AS grade,
               CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(c_mktsegment, '-', CAST(c_custkey % 6 AS STRING)) END AS class_name
        FROM {customer}""",
    "v_record": """
        SELECT o_orderkey AS record_id, c_nationkey AS organization_id, o_custkey AS user_id,
               min(o_orderkey) OVER (PARTITION BY o_custkey) AS root_record_id,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS version_no,
               concat('file-', CAST(o_orderkey % 400 AS STRING)) AS filename,
               CAST(floor(o_totalprice / 5000) AS DOUBLE) AS total_score,
               CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'failed' ELSE 'processing' END AS status,
               o_orderpriority AS target_position,
               CASE o_orderkey % 3 WHEN 0 THEN 'detected' WHEN 1 THEN 'manual' ELSE 'generic' END AS target_source,
               CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 200 END AS batch_id,
               CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 30 END AS job_profile_id,
               o_orderdate AS created_at
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "v_issue": "SELECT l_orderkey AS record_id, l_linenumber AS pos, concat(l_returnflag, '-', l_linestatus) AS issue FROM {lineitem}",
    "v_score": "SELECT l_orderkey AS record_id, concat('dim', CAST(l_linenumber AS STRING)) AS dimension, max(l_quantity) AS value FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "v_batch": """
        SELECT p_partkey AS batch_id, p_partkey % 150 AS user_id, p_name AS filename,
               CASE p_size % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'success' WHEN 2 THEN 'partial_success' ELSE 'failed' END AS status FROM {part}""",
    "v_batch_item": """
        SELECT l_partkey AS batch_id, concat('file-', CAST(l_orderkey % 400 AS STRING)) AS filename, l_linenumber AS item_no,
               CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'R' THEN 'failed' ELSE 'skipped' END AS status, l_shipdate AS ts FROM {lineitem}""",
    "v_upload": """
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS upload_id, l_orderkey AS record_id,
               concat('/data/', CAST(l_suppkey AS STRING), '/', CAST(l_partkey % 50 AS STRING)) AS stored_path FROM {lineitem}""",
    "v_report": """
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS report_id, l_orderkey AS record_id,
               CASE WHEN l_linenumber % 2 = 0 THEN 'pdf' ELSE 'docx' END AS format,
               concat('/rep/', CAST(l_orderkey AS STRING)) AS stored_path FROM {lineitem} WHERE l_linenumber <= 3""",
    "v_file": """
        SELECT p_partkey AS file_id,
               concat(CASE WHEN p_partkey % 17 = 0 THEN '~$' ELSE '' END, p_brand, '-', CAST(p_partkey AS STRING),
                      CASE p_partkey % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' ELSE '' END) AS name,
               concat('/data/', CAST(p_size AS STRING), '/', CAST(p_partkey % 60 AS STRING)) AS path FROM {part}""",
    "v_interval": """
        SELECT o_custkey AS person_id, o_orderkey AS seq,
               CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS start_m,
               CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 6 AS INT) AS end_m FROM {orders}""",
    "v_annot_a": "SELECT doc_id, quality, toxic FROM {labels}",
    "v_annot_b": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM {labels} WHERE doc_id % 13 <> 0",
    "v_resume": """
        SELECT doc_id, concat(
               CASE doc_id % 5 WHEN 0 THEN '王小明 / 数据分析' WHEN 1 THEN '姓名：李娜' WHEN 2 THEN '教育背景' WHEN 3 THEN '人力资源管理' ELSE 'Resume' END, chr(10),
               CASE doc_id % 3 WHEN 0 THEN concat('QQ：', CAST(100000 + doc_id AS STRING)) WHEN 1 THEN concat('微信: wx_', CAST(doc_id AS STRING)) ELSE concat('github.com/user-', CAST(doc_id AS STRING)) END, chr(10),
               CASE doc_id % 7 WHEN 0 THEN '手机：13800138000' WHEN 1 THEN '+86 139-0013-9000,13700137000' ELSE '' END, chr(10),
               CASE doc_id % 4 WHEN 0 THEN '现居：北京市海淀区中关村' WHEN 1 THEN '北方工业大学 软件工程专业 本科' WHEN 2 THEN '星河网络科技有限公司 实习生' ELSE '大学生活动中心大学 李娜' END, chr(10),
               coalesce(text, '')) AS text FROM {documents}""",
    "v_job_profile": "SELECT DISTINCT o_orderkey % 30 AS job_profile_id, concat('profile-', CAST(o_orderkey % 30 AS STRING)) AS name FROM {orders}",
}

_JOB = """
    SELECT item_id AS job_id, {position} AS position, {must} AS must, {nice} AS nice, text AS description,
           CASE WHEN item_id % 7 = 0 THEN 'search_result' ELSE 'job_page' END AS source_type,
           CASE item_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'single_source_verified' ELSE 'expert_reviewed' END AS review_status,
           concat('https://jobs.example.org/', CAST(item_id AS STRING)) AS source_url,
           concat('city-', CAST(item_id % 5 AS STRING)) AS city, concat('cat-', CAST(item_id % 4 AS STRING)) AS category,
           concat('company-', CAST(item_id % 9 AS STRING)) AS company,
           CASE item_id % 4 WHEN 0 THEN 'bachelor' WHEN 1 THEN 'master' WHEN 2 THEN 'college' ELSE '' END AS education,
           CASE item_id % 3 WHEN 0 THEN '3 years' WHEN 1 THEN 'internship' ELSE '' END AS experience
    FROM ({inner})"""

SPARK_ONLY = {
    "v_line": r"SELECT doc_id, CAST(pos + 1 AS INT) AS line_no, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line WHERE length(trim(line)) > 0",
    "v_job": _JOB.replace("{position}", "concat_ws(' ', slice(toks, 1, 2))").replace("{must}", "slice(toks, 3, 6)").replace("{nice}", "slice(toks, 9, 4)").replace(
        "{inner}", "SELECT *, array_distinct(filter(split(regexp_replace(lower(text), '[^a-z]+', ' '), ' '), x -> length(x) >= 3)) AS toks FROM {benchmark}"
    ),
}
DUCK_ONLY = {
    "v_line": """
        SELECT doc_id, CAST(i AS INT) AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l,
          unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE length(trim(l[i])) > 0""",
    "v_job": _JOB.replace("{position}", "array_to_string(toks[1:2], ' ')").replace("{must}", "toks[3:8]").replace("{nice}", "toks[9:12]").replace(
        "{inner}",
        "SELECT *, list_filter(l0, lambda x, i: list_position(l0, x) = i) AS toks FROM (SELECT *, "
        "list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: length(x) >= 3) AS l0 FROM benchmark)",
    ),
}


class Views:
    """The given tables and the views over them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = SPARK_ONLY.get(name) or VIEWS[name]
        return self.spark.sql(text, **{t: getattr(self, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def duck(sql: str, **more: str) -> str:
    """The SQL with the views it names, and those given, as common table expressions before it."""
    texts = {n: re.sub(r"\{(\w+)\}", r"\1", t) for n, t in (VIEWS | DUCK_ONLY).items()} | more
    needed: list[str] = []

    def need(text: str) -> None:
        for name in texts:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                if texts[name] is not text:
                    need(texts[name])
                    needed.append(name)

    need(sql)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    head = ", ".join(f"{n} AS ({texts[n].strip()})" for n in needed)
    if re.match(r"WITH\b", body, re.I):
        rest = re.sub(r"^WITH(\s+RECURSIVE)?\s+", "", body, flags=re.I)
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if head else ''}{rest}"
    return f"WITH {head} {body}" if head else body
