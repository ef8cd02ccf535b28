"""Terms in documents: hits, spans, keywords, frequencies, cosine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_kw

#: Terms of letters and + # . match whole words; a word is a run of these characters and digits.
WORDLIKE, RUN = r"^[a-z+#.]{2,}$", r"[a-z0-9+#.]+"
#: Distinct substring terms that go into one array of literals at most; more are joined by their grams.
SUBSTRING_TERMS = 500
#: Whole-word names that are looked for in each text at most; more are joined with its words.
WORD_TERMS = 40
#: Characters of a gram; a shorter term is its own.
GRAM = 3
#: Characters of a word beside a gap that are looked up.
ENDS = 2
#: A word and what stands between two of them, for terms of several words.
WORD, GAP = r"[\p{L}\p{N}]+", r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]+(?=[\p{L}\p{N}])"
#: Names that are broadcast at most; the grams of the texts are shuffled for more.
BROADCAST_NAMES = 200_000
#: Characters of texts whose spans one task puts in order, and partitions at most.
TASK_CHARS, MOST_SPAN_PARTS = 8_000_000, 20_000
#: Terms with their idf, and rows of the right side's vectors, that are broadcast at most.
BROADCAST_TERMS = 1_000_000


def runs(text: Column) -> Column:
    """Distinct words of a text, without full stops at their ends."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0)), lambda w: F.rtrim(w, F.lit("."))))


def match_terms(docs: DataFrame, terms: DataFrame, aliases: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", once: bool = True) -> DataFrame:
    """C8. (key, term) for each term that a text holds, itself or under another name. Up to `WORD_TERMS` whole words are looked for in each text, more join on the texts' words; up to `SUBSTRING_TERMS`
    others are tested as parts of each text, more join by the ends of the words around a gap or, where they have none, by grams. Not `once`: rows may repeat, which saves a shuffle where they are grouped anyway."""
    spark = docs.sparkSession
    known = terms.select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()
    named = known.select("term", F.col("term").alias("name"))
    if aliases:
        pairs = spark.createDataFrame([(a, r) for a, r in aliases.items()], "alias string, root string")
        roots = known.join(pairs.withColumnRenamed("alias", "term"), "term", "left").select("term", F.coalesce("root", "term").alias("root"))
        named = named.unionByName(roots.select("term", F.col("root").alias("name"))).unionByName(roots.join(pairs, "root").select("term", F.col("alias").alias("name"))).distinct()
    single = (lambda df: df.distinct()) if once else (lambda df: df)
    whole = single(_by_words(docs, named.where(F.col("name").rlike(WORDLIKE)), key, text))
    parts = named.where(~F.col("name").rlike(WORDLIKE))
    few = parts.limit(SUBSTRING_TERMS + 1).collect()
    if not few:
        return whole
    if len(few) > SUBSTRING_TERMS:
        gapped = parts.withColumn("gapped", F.col("name").rlike(GAP))
        some, rest = gapped.where("gapped").drop("gapped"), gapped.where("NOT gapped").drop("gapped")
        found = _by_gaps(docs, some, key, text)
        return single(whole.unionByName(found if rest.isEmpty() else found.unionByName(_by_grams(docs, rest, key, text))))
    some = F.array(*(F.struct(F.lit(r.term).alias("term"), F.lit(r.name).alias("name")) for r in few))
    low = F.lower(F.col(text))
    found = docs.select(key, F.explode(F.array_distinct(F.transform(F.filter(some, lambda x: F.contains(low, x["name"])), lambda x: x["term"]))).alias("term"))
    return single(whole.unionByName(found))


def _by_words(docs: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) of the names (term, name) that texts hold as whole words; rows may repeat where docs do. No text is taken apart for few names; else the names are broadcast if they are few enough for that."""
    few = names.limit(WORD_TERMS + 1).collect()
    if not 0 < len(few) <= WORD_TERMS:
        return docs.select(key, F.explode(runs(F.col(text))).alias("name")).join(_sent(names), "name").select(key, "term")
    low = F.col("low")
    # no word ends in a full stop, see runs()
    held = F.array(*(F.when(F.lit(not r.name.endswith(".")) & F.contains(low, F.lit(r.name)) & contains_kw(low, r.name), F.lit(r.term)) for r in few))
    return docs.select(key, F.lower(F.col(text)).alias("low")).select(key, F.explode(F.array_distinct(F.array_compact(held))).alias("term"))


def _sent(names: DataFrame) -> DataFrame:
    """Names to be broadcast, if they are few enough for that."""
    return F.broadcast(names) if _few(names.select("name"), BROADCAST_NAMES) else names


def _few(rows: DataFrame, most: int) -> bool:
    return rows.limit(most + 1).count() <= most


def _gaps(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """Rows of those kept, with each gap between two words of a text and these words."""
    found = rows.select(*keep, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.regexp_extract_all(text, F.lit(GAP), F.lit(0)).alias("gap"))
    n = F.greatest(F.size("words") - 1, F.lit(0))
    return found.select(*keep, F.inline(F.arrays_zip(F.slice("words", F.lit(1), n).alias("before"), "gap", F.slice("words", F.lit(2), n).alias("after"))))


def _ends(a: int, b: int) -> Column:
    """A gap with the last a characters of the word before it and the first b of that after it."""
    return F.when((F.length("before") >= a) & (F.length("after") >= b), F.concat(F.right("before", F.lit(a)), "gap", F.left("after", F.lit(b))))


def _by_gaps(docs: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) of the names (term, name) of several words that texts hold as parts. Between its first and last word a name has whole gaps: the word before one ends a
    word of the text, that after it begins one. The gap of each name whose ends fewest names have joins with the texts' gaps, and the two words are verified at once;
    names with more than these two words are verified by contains() as well. No text is shuffled but for the latter, and then only those that hold such a gap."""
    sizes = (F.least(F.length("before"), F.lit(ENDS)), F.least(F.length("after"), F.lit(ENDS)))
    gaps = _gaps(names.select("name").distinct(), F.col("name"), "name").withColumns({"a": sizes[0], "b": sizes[1]})
    gaps = gaps.withColumn("gram", F.concat(F.right("before", F.col("a")), "gap", F.left("after", F.col("b"))))
    shared = gaps.groupBy("gram").agg(F.countDistinct("name").alias("shared"))
    one = gaps.join(shared, "gram").groupBy("name").agg(F.min(F.struct("shared", "gram", "before", "gap", "after", "a", "b")).alias("g")).select("name", "g.gram", F.col("g.before").alias("ends"), F.col("g.after").alias("begins"), "g.a", "g.b", (F.concat("g.before", "g.gap", "g.after") == F.col("name")).alias("whole"))
    pairs = sorted((r.a, r.b) for r in one.select("a", "b").distinct().collect())  # ENDS * ENDS at most
    held = _gaps(docs, F.lower(F.col(text)), key).select(key, "before", "after", F.explode(F.array_compact(F.array(*(_ends(a, b) for a, b in pairs)))).alias("gram"))
    near = held.join(_sent(one.select("gram", "name", "ends", "begins", "whole")), "gram").where(F.endswith("before", "ends") & F.startswith("after", "begins"))
    found = near.where("whole").select(key, "name")
    if not one.where("NOT whole").isEmpty():
        found = found.unionByName(_verified(docs, near.where("NOT whole").select(key, "name").distinct(), key, text))
    return found.join(_sent(names), "name").select(key, "term")


def _verified(docs: DataFrame, near: DataFrame, key: str, text: str) -> DataFrame:
    """Those of the pairs (key, name) whose text does hold the name."""
    texts = docs.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("low"))
    return near.join(texts, near[key].eqNullSafe(texts["k"]) & F.contains("low", "name")).select(key, "name")


def _grams(c: str, n: int) -> Column:
    """Distinct runs of n of an array of characters."""
    at = F.sequence(F.lit(1), F.size(c) - (n - 1))
    return F.when(F.size(c) >= n, F.array_distinct(F.transform(at, lambda i: F.concat(*(F.element_at(c, i + k) for k in range(n)))))).otherwise(F.array().cast("array<string>"))


def _by_grams(docs: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) of the names (term, name) that texts hold as parts: one gram of each, that which fewest names have, joins with the texts' grams, and contains() verifies.
    One scan of the texts for the grams and one for the rest, whatever the number of names, none of which passes the driver."""
    chars = names.withColumn("chars", F.split("name", ""))
    n = F.least(F.size("chars"), F.lit(GRAM)).alias("n")
    grams = chars.select("term", "name", n, F.explode(F.when(F.size("chars") < GRAM, F.array("name")).otherwise(_grams("chars", GRAM))).alias("gram"))
    shared = grams.groupBy("gram").agg(F.countDistinct("name").alias("shared"))
    rarest = grams.join(shared, "gram").groupBy("name", "n").agg(F.min(F.struct("shared", "gram"))["gram"].alias("gram"))
    sizes = [r.n for r in rarest.select("n").distinct().collect()]  # GRAM numbers at most
    letters = docs.select(key, F.split(F.lower(F.col(text)), "").alias("chars"))
    held = letters.select(key, F.explode(F.concat(*(_grams("chars", n) for n in sorted(sizes)))).alias("gram"))
    near = held.join(_sent(rarest.select("gram", "name")), "gram").select(key, "name").distinct()
    return _verified(docs, near, key, text).distinct().join(names, "name").select(key, "term")


def hit_sections(section_lines: DataFrame, terms: DataFrame, aliases: dict[str, str] | None = None, once: bool = True) -> DataFrame:
    """C9. Sections of a document in which each of its hit terms stands. Lines are matched one by one, no section's text is gathered. Not `once`: rows may repeat."""
    keyed = section_lines.select(F.struct("doc_id", "section").alias("doc_id"), F.col("line").alias("text"))
    hits = match_terms(keyed, terms, aliases, once=once)
    return hits.select("doc_id.doc_id", "doc_id.section", "term")


def hit_spans(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """E12. Merged spans of all occurrences of the terms, as code points from 0, end exclusive; a span that starts at or after the last end opens a new one.

    Where an occurrence starts is what stands before it, added up over the pieces between a term's occurrences. A doc_id is one row; one
    shuffle by it serves both windows, whose partitions follow the length of the texts: what moves is short and grows many times where it arrives.
    """
    low = F.lower(F.col("text"))
    between = lambda term: F.transform(F.split(low, F.lit("\\Q" + term + "\\E"), -1), F.length)
    found = [F.struct(F.lit(i).alias("term"), F.lit(len(t)).alias("n"), between(t).alias("lengths")) for i, t in enumerate(sorted({t.lower() for t in terms} - {""}))]
    if not found:
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end")).limit(0)
    held = docs.select("doc_id", F.explode(F.array(*found)).alias("s")).select("doc_id", "s.*").where(F.size("lengths") > 1).repartition(_span_parts(docs), "doc_id")
    pieces = held.select("doc_id", "term", "n", F.size("lengths").alias("pieces"), F.posexplode("lengths").alias("i", "length")).where("i < pieces - 1")
    before = Window.partitionBy("doc_id", "term").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = pieces.withColumn("start", F.sum("length").over(before) + F.col("i") * F.col("n")).select("doc_id", "start", (F.col("start") + F.col("n")).alias("end"))
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(seen.isNull() | (F.col("start") >= seen), 1).otherwise(0)).withColumn("island", F.sum("opens").over(w))
    return opened.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "start", "end")


def _span_parts(docs: DataFrame) -> int:
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(MOST_SPAN_PARTS, max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9+#.]*"), F.lit(0))


def top_keywords(docs: DataFrame, phrases: Sequence[str], stop_words: Sequence[str], n: int = 30) -> DataFrame:
    """E18. Phrases of the lexicon that the text holds, in its order, then its words by frequency; no digits, no stop words, two letters at least."""
    low = F.lower(F.col("text"))
    found = docs.select("doc_id", F.posexplode(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))).alias("i", "keyword")).select("doc_id", "keyword", F.lit(0).alias("kind"), F.col("i").cast("bigint").alias("rank"))
    counts = docs.select("doc_id", F.explode(words(F.col("text"))).alias("keyword")).where((F.length("keyword") >= 2) & ~F.col("keyword").isin(*stop_words)).groupBy("doc_id", "keyword").agg(F.count("*").alias("n"))
    free = counts.join(found.select("doc_id", "keyword"), ["doc_id", "keyword"], "left_anti").select("doc_id", "keyword", F.lit(1).alias("kind"), (-F.col("n")).alias("rank"))
    w = Window.partitionBy("doc_id").orderBy("kind", "rank", "keyword")
    return found.unionByName(free).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("doc_id", "keyword", "place")


def fit_idf(docs: DataFrame, text: str = "text") -> DataFrame:
    """D21. term, df and idf = ln((1 + N) / (1 + df)) + 1 over all documents."""
    n = docs.agg(F.count("*").alias("docs"))
    df = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def vectors(docs: DataFrame, idf: DataFrame, tokens: Column, key: str, more: Column | None = None) -> DataFrame:
    """(key, term, weight, expanded): term frequency times idf (1 where unknown), of length 1; expanded counts the tokens in `more` too. The texts move once, by key: counts and
    lengths come from there, without a join; with an idf that is broadcast nothing else moves."""
    none = F.array().cast("array<string>")
    rows = docs.repartition(key).select(key, tokens.alias("own"), (none if more is None else more).alias("more"))
    rows = rows.select(key, F.size("own").alias("n"), F.posexplode(F.concat("own", "more")).alias("i", "term"))
    tf = rows.groupBy(key, "term").agg(F.count_if(F.col("i") < F.col("n")).alias("tf"), F.count("*").alias("tf_all"))
    factor = F.coalesce("idf", F.lit(1.0))
    weighed = tf.join(idf, "term", "left").select(key, "term", (F.col("tf") * factor).alias("w"), (F.col("tf_all") * factor).alias("w_all"))
    length = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)).over(Window.partitionBy(key)))
    return weighed.select(key, "term", F.coalesce(F.try_divide("w", length("w")), F.lit(0.0)).alias("weight"), (F.col("w_all") / length("w_all")).alias("expanded"))


def tfidf_cosine(
    left: DataFrame, right: DataFrame, idf: DataFrame, left_tokens: Column, right_tokens: Column, left_key: str, right_key: str, left_more: Column | None = None, right_more: Column | None = None, least: float = 0.0
) -> DataFrame:
    """H20. Cosine, score (0..100) and confidence of each pair that shares a term: the greater of the plain cosine and that with the tokens in `more`
    (absent_roots), both from one pass. Joined on terms, never as a product of all pairs. With `least` only pairs whose cosine reaches it.

    A right side of few rows is broadcast, so that pairs are summed where the left side's texts are. For a greater one, with `least`, those that share a term in prefix() of both
    are summed, so that common words bring no pairs together; a pair then costs the left vector, which is more than its common terms."""
    idf = idf.select("term", "df", "idf").persist(StorageLevel.DISK_ONLY)  # it is asked for three times
    known = idf.select("term", "idf")
    known = F.broadcast(known) if _few(known, BROADCAST_TERMS) else known
    a, b = vectors(left, known, left_tokens, left_key, left_more), vectors(right, known, right_tokens, right_key, right_more)
    other = b.select(right_key, "term", F.col("weight").alias("other"), F.col("expanded").alias("other_expanded"))
    sums = F.greatest(F.sum(F.col("weight") * F.col("other")), F.sum(F.col("expanded") * F.col("other_expanded")))
    few = _few(right.select(F.explode(right_tokens)), BROADCAST_TERMS)
    if least > 0 and not few:
        pairs = prefix(a, idf, left_key, least).join(prefix(b, idf, right_key, least), "term").select(left_key, right_key).distinct()
        met = pairs.join(a, left_key).join(other, [right_key, "term"])
    else:
        met = a.join(F.broadcast(other) if few else other, "term")
    dot = met.groupBy(left_key, right_key).agg(sums.alias("cosine")).where(F.col("cosine") >= least)
    return dot.select(left_key, right_key, "cosine", (F.col("cosine") * 100).alias("score"), F.least(F.lit(0.88), 0.45 + 0.42 * F.col("cosine")).alias("confidence"))


def prefix(rows: DataFrame, idf: DataFrame, key: str, least: float) -> DataFrame:
    """(key, term): of each vector its rarest terms, so many that the rest has a length under `least`. The order of terms is the same for all vectors: if two have no term in
    common within both prefixes, all they share is in the rest of one of them, which brings less than `least`."""
    order = Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "term").rowsBetween(0, Window.unboundedFollowing)
    rest = lambda c: F.sum(F.col(c) * F.col(c)).over(order)
    ranked = rows.join(idf.select("term", "df"), "term", "left").withColumn("rest", F.greatest(rest("weight"), rest("expanded")))
    return ranked.where(F.col("rest") >= least * least - 1e-9).select(key, "term")


def vector_cosine(a: Column, b: Column) -> Column:
    """H21. Cosine of two dense vectors, clipped to 0..1; 0 for a vector of zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, F.least(F.greatest(dot(a, b) / norm, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def fuse(rule: Column, semantic: Column, alpha: float) -> Column:
    """H21. alpha * rule + (1 - alpha) * semantic, held to 0..100."""
    return F.least(F.greatest(alpha * rule + (1 - alpha) * semantic, F.lit(0.0)), F.lit(100.0))
