"""The queries of this subpackage: the whole intended table in, the operator's full result out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, flac, jaccard, packing, periods, repair, secrets, simhash, tokens, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The bare file name: each task looks it up on its own machine."""
    return name


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


#: Of the tools that the conversations' calls name.
SCHEMAS = {
    "lookup": {"query": ("STRING", True), "max_words": ("NUMBER", False), "strict": ("BOOLEAN", False)},
    "search": {"query": ("STRING", True), "max_words": ("NUMBER", False)},
    "summarise": {"query": ("STRING", False), "max_words": ("NUMBER", True)},
}
#: The url rules, as given.
RULES = (urls.Rule("org", "/", "allow"), urls.Rule("example.org", "/es/", "block"), urls.Rule("example.org", "/en/1", "block"), urls.Rule("com", "/fr/", "allow"), urls.Rule("com", "/de/", "block"))
#: A domain is listed if its first label is one of these.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn is a call whose name, arguments and dependencies its text gives; each later user turn is the result of the call before it."""
    turns = table(spark, sf_dir, "conversations")
    n = F.coalesce(F.length("text"), F.lit(0))
    call_id = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    text = F.coalesce("text", F.lit(""))
    quoted = F.expr("substr(to_json(struct(coalesce(text, '') AS t)), 6, length(to_json(struct(coalesce(text, '') AS t))) - 6)")
    arguments = (
        F.when(n % 13 == 0, F.concat(F.lit('{ "query" : "'), text))
        .when(n % 11 == 0, F.format_string('{ "max_words":%d }', n))
        .when(n % 7 == 0, F.format_string('{ "query" : 5, "max_words" : %d.0}', n))
        .when(n % 5 == 0, F.format_string('{ "tone": [1, {"b": null, "a": true}], "max_words" : %de0}', n))
        .otherwise(F.concat(F.lit('{"query" : '), quoted, F.format_string(',  "max_words" : %d }', n)))
    )
    after = F.when(n % 3 == 0, F.array(call_id(F.col("turn") - 2))).when(n % 8 == 1, F.array(call_id(F.col("turn") + 2))).otherwise(F.array().cast("array<string>"))
    names = F.element_at(F.array(*map(F.lit, ("search", "lookup", "summarise", "forecast"))), (n % 4 + 1).cast("int"))
    calls = turns.where("role = 'assistant'").select("conv_id", call_id(F.col("turn")).alias("call_id"), F.col("turn").alias("seq"), names.alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = turns.where("role = 'user' AND turn > 0").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return chat.link_tool_calls(calls, results, SCHEMAS)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.where(~held_out()))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_features(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES, lambda key: F.split_part(key, F.lit("."), F.lit(1)).isin(*LISTED_LABELS))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text; one turn in five is dropped, emptied, cut off, repeated or given to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("kind")).where("kind > 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies).drop("copy")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repair.Repair(damaged(turns))
    out = turns.select("conv_id").distinct()
    for part in (found.conversations, found.hashes):
        part = part.withColumnRenamed("conv_id", "id")
        out = out.join(part, out["conv_id"].eqNullSafe(part["id"]), "left").drop("id")
    numbers = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def periodic(docs: DataFrame) -> DataFrame:
    """docs, of which one in ten repeats, from some word on, the words that follow there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    # null ids are left as they are
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), 1, left)
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.periodic_runs(periodic(table(spark, sf_dir, "documents"))))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_tool_calls, op2_decontaminate, op3_toxicity, op4_flac, op5_secrets, op6_jaccard_join, op7_token_counts, op8_harmonic_packing, op9_packed_ids, op10_url_cascade, op11_structure_repair, op12_periodic_runs, op13_simhash)}

from .oracles import ORACLES  # noqa: E402, F401
