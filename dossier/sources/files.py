"""Scans and sinks over files and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = (".txt", ".md")
#: Declared schemas of the record tables.
SCHEMAS = {
    "organizations": "organization_id bigint, name string",
    "users": "user_id bigint, organization_id bigint, username string, role string, status string, created_at timestamp",
    "user_profiles": "user_id bigint, school string, major string, grade string, class_name string",
    "audit_logs": "audit_id bigint, user_id bigint, action string, detail_json string, created_at timestamp",
    "batch_tasks": "batch_id bigint, organization_id bigint, user_id bigint, filename string, status string, created_at timestamp",
    "analysis_records": "record_id bigint, organization_id bigint, user_id bigint, root_record_id bigint, parent_record_id bigint, version_no int, filename string, target_position string, total_score double, status string, "
    "scores map<string,double>, sections map<string,array<string>>, diagnosis array<string>, created_at timestamp",
    "uploaded_files": "upload_id bigint, record_id bigint, stored_path string, created_at timestamp",
    "reports": "report_id bigint, record_id bigint, format string, stored_path string, created_at timestamp",
    "job_profiles": "job_profile_id bigint, organization_id bigint, name string, category string, description string, archived boolean",
}
JOB = (
    "id string, source_type string, review_status string, source_url string, target_position string, category string, company string, city string, education struct<raw:string>, experience struct<raw:string>, "
    "must_skills array<string>, nice_skills array<string>, responsibilities array<string>, source_evidence string"
)


def read_documents(spark: SparkSession, path: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """A1. Text files below a folder: doc_id, path, suffix, text, warnings. Temporary (~$), hidden and readme files and other suffixes are left out; a blank file has a warning, one that is not UTF-8 empty text too; Spark's readers pass over files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("raw"))
    files = files.withColumn("text", F.when(F.is_valid_utf8("raw"), F.col("raw")).otherwise(""))
    suffix = F.lower(F.regexp_extract("name", r"\.[^.]+$", 0))
    kept = files.withColumn("suffix", suffix).where(suffix.isin(*suffixes) & ~F.startswith("name", F.lit("~$")) & ~F.startswith("name", F.lit(".")) & ~F.lower("name").rlike(r"^readme"))
    warnings = F.when(~F.col("text").rlike(r"\S"), F.array(F.lit("no_text"))).otherwise(F.array().cast("array<string>"))
    return kept.select(F.xxhash64("path").alias("doc_id"), "path", "suffix", "text", warnings.alias("warnings"))


def read_jobs(spark: SparkSession, path: str, schema: str | T.StructType = JOB) -> DataFrame:
    """A2. Postings, one JSON object a line; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A3. The rows of the array `cases` of one JSON object."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("cases").alias("c")).select("c.*")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A4. A record table with its declared schema; columns that an old snapshot lacks are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load_aliases(synonyms: DataFrame, nodes: DataFrame) -> DataFrame:
    """A5. (alias, root) from synonyms (root, aliases) and graph nodes (name, aliases), in lower case; the graph has precedence, then the smaller root."""
    long = lambda df, root, rank: df.select(F.lower(F.trim(root)).alias("root"), F.explode(F.concat(F.array(root), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"), F.lit(rank).alias("rank"))
    rows = long(synonyms, "root", 1).unionByName(long(nodes, "name", 0)).select("root", F.lower(F.trim("alias")).alias("alias"), "rank").where("alias <> '' AND root <> ''")
    return rows.groupBy("alias").agg(F.min(F.struct("rank", "root")).alias("b")).select("alias", F.col("b.root").alias("root"))


def write_stats(stats: Mapping[str, DataFrame], path: str) -> None:
    """A7. Each statistic as UTF-8 CSV in a folder of its name."""
    for name, df in stats.items():
        df.coalesce(1).write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(f"{path.rstrip('/')}/{name}")


def write_pools(df: DataFrame, path: str) -> None:
    """A8. Rows by pool."""
    df.write.mode("overwrite").partitionBy("pool").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A9. One JSON object a line."""
    df.write.mode("overwrite").json(path)


__all__ = ["JOB", "SCHEMAS", "load_aliases", "read_cases", "read_documents", "read_jobs", "read_table", "write_jsonl", "write_pools", "write_stats"]
