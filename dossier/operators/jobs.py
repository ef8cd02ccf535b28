"""Job postings: filters, cleaning, scoring of documents against them, ranking and choice."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import SECTION_NAMES, SECTION_WEIGHTS, SNIPPET_BONUS
from ..functions.text import contains_kw, job_tokens
from .terms import WORDLIKE, match_terms, runs

ACCEPTED = ("single_source_verified", "expert_reviewed")
PLACEHOLDERS = r"(?i)^(see (above|description)|n/?a|none|tbd|-+)$"
MOST_TERMS, MOST_SKILLS = 32, 12
STRONG, WEAK_SECTIONS = ("skills", "projects", "internship"), ("skills", "projects", "internship", "campus")
DEGREE_RANK = {"college": 1, "bachelor": 2, "master": 3, "doctor": 4}

#: Terms too common to be asked for by themselves.
COMMON_TERMS = ("分析", "处理", "优化", "管理", "支持", "服务", "业务", "项目", "活动", "方案", "报告", "数据")


def verified_jobs(jobs: DataFrame) -> DataFrame:
    """B1. Postings from a job page, reviewed, with a position and a url."""
    return jobs.where((F.col("source_type") == "job_page") & F.col("review_status").isin(*ACCEPTED) & (F.trim("position") != "") & (F.trim("source_url") != ""))


def filter_jobs(jobs: DataFrame, city: str = "", category: str = "", education: str = "") -> DataFrame:
    """B3. Postings whose columns hold the needles in any case; an empty needle passes; with the totals of both sets."""
    good = verified_jobs(jobs)
    for column, needle in (("city", city), ("category", category), ("education", education)):
        good = good.where(F.contains(F.lower(column), F.lit(needle.strip().lower())))
    totals = verified_jobs(jobs).agg(F.count("*").alias("verified_total")).crossJoin(good.agg(F.count("*").alias("filtered_total")))
    return good.crossJoin(F.broadcast(totals))


def search_jobs(jobs: DataFrame, city: str = "", category: str = "", degree: str = "", keyword: str = "") -> DataFrame:
    """B4. Exact facets, and a keyword in position, company, category or skills."""
    for column, value in (("city", city), ("category", category), ("education", degree)):
        if value:
            jobs = jobs.where(F.col(column) == value)
    hay = F.lower(F.concat_ws(" ", "position", "company", "category", F.array_join("must", " ")))
    return jobs.where(F.contains(hay, F.lit(keyword.strip().lower())))


def find_job(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """B5. For each wanted (want_id, job_id, source_url, position) the first posting that has the id or the url, else the first of the position."""
    hit = (F.col("w.job_id") == F.col("j.job_id")) | ((F.col("w.source_url") != "") & (F.col("w.source_url") == F.col("j.source_url")))
    by_key = wanted.alias("w").join(jobs.alias("j"), F.expr("w.job_id = j.job_id"))
    by_url = wanted.alias("w").join(jobs.alias("j"), F.expr("w.source_url = j.source_url AND w.source_url <> ''"))
    by_position = wanted.alias("w").join(jobs.alias("j"), F.expr("lower(w.position) = lower(j.position) AND w.position <> ''"))
    pick = lambda df: df.select("w.want_id", "j.job_id", F.when(F.coalesce(hit, F.lit(False)), 0).otherwise(1).alias("priority"))
    found = pick(by_key).unionByName(pick(by_url)).unionByName(pick(by_position))
    return found.groupBy("want_id").agg(F.min(F.struct("priority", "job_id")).alias("best")).select("want_id", F.col("best.job_id").alias("job_id"))


def public_jobs(jobs: DataFrame) -> DataFrame:
    """B9. What the public sees of a posting: cleaned skills and duties, no evidence of the scrape."""
    duties = clean_duties(F.split("description", r"(?<=[.\n])\s*"))
    return jobs.select("job_id", "position", "category", "company", "city", "education", "experience", clean_skills(F.col("must")).alias("must_skills"), clean_skills(F.col("nice")).alias("nice_skills"), duties.alias("responsibilities"))


def clean_skills(skills: Column, derived: Column | None = None, most: int = MOST_SKILLS) -> Column:
    """H11. Distinct skills in order, without placeholders; where none is left, the derived ones."""
    tidy = F.transform(F.coalesce(skills, F.array().cast("array<string>")), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    kept = F.array_distinct(F.filter(tidy, lambda s: (s != "") & ~s.rlike(PLACEHOLDERS)))
    return F.slice(kept if derived is None else F.when(F.size(kept) > 0, kept).otherwise(derived), 1, most)


def derive_skills(text: Column, lexicon: Sequence[str], trigger: str = r"(?i)(?:familiar with|skilled in|knows) ([a-z+#. ]{2,28})") -> Column:
    """H11. Terms of the lexicon that a text holds, then the phrases after a trigger."""
    low = F.lower(text)
    known = F.filter(F.array(*map(F.lit, lexicon)), lambda t: F.contains(low, F.lower(t)))
    return F.array_distinct(F.concat(known, F.transform(F.regexp_extract_all(text, F.lit(trigger), F.lit(1)), lambda p: F.substring(F.trim(p), 1, 24))))


def clean_duties(duties: Column, most: int = 12) -> Column:
    """H11. Duties without placeholders, 180 characters each."""
    tidy = F.transform(duties, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.slice(F.transform(F.filter(tidy, lambda s: (s != "") & ~s.rlike(PLACEHOLDERS)), lambda s: F.substring(s, 1, 180)), 1, most)


def term_groups(jobs: DataFrame) -> DataFrame:
    """H12. Terms of a posting by group, and all of them (32 at most)."""
    tokens = lambda c: F.filter(F.array_distinct(F.flatten(F.transform(c, lambda s: job_tokens(s)))), lambda t: F.length(t) >= 2)
    rows = jobs.withColumns({"t_position": tokens(F.array("position", "category")), "t_must": tokens(clean_skills(F.col("must"))), "t_nice": tokens(clean_skills(F.col("nice")))})
    return rows.withColumn("t_all", F.slice(F.array_distinct(F.concat("t_position", "t_must", "t_nice")), 1, MOST_TERMS))


def job_text(jobs: DataFrame) -> DataFrame:
    """H12. The description of a posting in labelled lines; empty ones are left out."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ": "), c))
    join = lambda c: F.array_join(clean_skills(F.col(c)), ", ")
    return jobs.select("job_id", F.concat_ws("\n", line("category", F.col("category")), line("education", F.col("education")), line("experience", F.col("experience")), line("must", join("must")), line("nice", join("nice"))).alias("text"))


def job_terms(jobs: DataFrame) -> DataFrame:
    """(job_id, term, is_must, is_nice, is_position) of all terms."""
    rows = term_groups(jobs).select("job_id", "t_must", "t_nice", "t_position", F.explode("t_all").alias("term"))
    return rows.select("job_id", "term", *(F.array_contains(f"t_{g}", F.col("term")).cast("int").alias(f"is_{g}") for g in ("must", "nice", "position")))


def candidate_pairs(docs: DataFrame, jobs: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """C10. (doc_id, job_id, term, ...) for each term of a posting that a document holds: an inverted index, no product of all pairs."""
    terms = job_terms(jobs)
    return match_terms(docs, terms.select("term"), dict(aliases or {})).join(terms, "term")


def _section_bit(section: Column, names: Sequence[str]) -> Column:
    """The bit of a section's name; all names that are not listed share one."""
    bits = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(1 << i).cast("bigint"))))
    return F.coalesce(F.try_element_at(bits, section), F.lit(1 << len(names)).cast("bigint"))


def _section_weight(mask: Column, names: Sequence[str]) -> Column:
    """Weight of the sections whose bits are set."""
    weights = [SECTION_WEIGHTS.get(n, 1.0) for n in names] + [1.0]
    return reduce(Column.__add__, (F.when(mask.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, w).otherwise(0.0) for i, w in enumerate(weights)))


#: Shares of must, nice and position terms in a posting's coverage.
KINDS = ("must", "nice", "position")
COVERAGE = (0.55, 0.2, 0.25)


def request_words(request: str) -> list[str]:
    """H2. The distinct words of a request, as job_tokens gives those of a column."""
    return list(dict.fromkeys(re.findall("[a-z][a-z0-9+#.-]+|[\u4e00-\u9fa5]{2,}", request.lower())))


def context_share(request: str) -> Column:
    """Of rows with t_all: the posting's terms that hold a word of the request, over its words (8 at most); 0 without words."""
    words = request_words(request)
    if not words:
        return F.lit(0.0)
    return F.size(F.filter("t_all", lambda t: reduce(Column.__or__, (contains_kw(t, w) for w in words)))) / F.lit(max(min(len(words), 8), 1))


def weights(request: str) -> tuple[float, float, float]:
    """What coverage, evidence and context count in a score."""
    return (0.65, 0.15, 0.2) if request.strip() else (0.8, 0.2, 0.0)


def posting_terms(jobs: DataFrame, request: str) -> DataFrame:
    """Each term of each posting: which kinds it is of, how many terms of each kind the posting has, its context, and the term's share of its coverage."""
    groups = term_groups(jobs).select("job_id", *(F.col(f"t_{g}") for g in KINDS), *(F.size(f"t_{g}").alias(f"n_{g}") for g in KINDS), context_share(request).alias("context"), F.explode("t_all").alias("term"))
    rows = groups.select("job_id", "term", *(F.array_contains(f"t_{g}", F.col("term")).cast("int").alias(f"is_{g}") for g in KINDS), *(f"n_{g}" for g in KINDS), "context")
    return rows.withColumn("share", sum((w * F.col(f"is_{g}") / F.greatest(f"n_{g}", F.lit(1)) for w, g in zip(COVERAGE, KINDS, strict=True)), F.lit(0.0)))


#: Pairs of documents and postings that meet in one task at most, and partitions that are made for that at most.
TASK_PAIRS, MOST_PARTS = 200_000, 20_000


def pair_parts(docs: DataFrame, jobs: DataFrame) -> int:
    """In how many partitions documents meet the postings: so many that a task's pairs stay as many, whatever the number of documents."""
    most = docs.count() * jobs.count()
    return min(max(-(-most // TASK_PAIRS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_PARTS)


#: Stands for no term: what a document without a hit meets postings by.
NO_TERM = ""


def held_terms(docs: DataFrame, terms: DataFrame, section_hits: DataFrame, names: Sequence[str], parts: int | None = None, listed: bool = False) -> DataFrame:
    """(doc_id, term, held): terms that a document holds, and the bits of the sections where it does; by doc_id, in `parts` partitions (pair_parts()). Both meet in one shuffle,
    without a join. `listed`: each document holds NO_TERM too."""
    if len(names) > 62:
        raise ValueError("62 section names at most")
    stands = section_hits.select("doc_id", "term", _section_bit(F.col("section"), names).alias("held"), F.lit(False).alias("hit"))
    rows = match_terms(docs, terms, once=False).select("doc_id", "term", F.lit(None).cast("bigint").alias("held"), F.lit(True).alias("hit")).unionByName(stands)
    if listed:
        rows = rows.unionByName(docs.select("doc_id", F.lit(NO_TERM).alias("term"), F.lit(None).cast("bigint").alias("held"), F.lit(True).alias("hit")))
    return rows.repartition(*([parts] if parts else []), "doc_id").groupBy("doc_id", "term").agg(F.bit_or("held").alias("held"), F.bool_or("hit").alias("hit")).where("hit").drop("hit")


def scored(rows: DataFrame, sections: DataFrame, request: str, names: Sequence[str], more: Sequence[Column] = (), kept: Column | None = None) -> DataFrame:
    """The pairs of rows (doc_id, job_id, a posting's term with its kinds, held), summed; those whose sums in `more` are `kept`."""
    total = sections.groupBy("doc_id").agg(_section_weight(F.bit_or(_section_bit(F.col("section"), names)), names).alias("all_weight"))
    known = (*(f"n_{g}" for g in KINDS), "context")
    rows = rows.groupBy("doc_id", "job_id").agg(*(F.sum(f"is_{g}").alias(f"hit_{g}") for g in KINDS), F.count_if(F.col("term") != NO_TERM).alias("hits"), F.bit_or("held").alias("held"), *(F.max(c).alias(c) for c in known), *more)
    rows = rows if kept is None else rows.where(kept)
    rows = rows.withColumn("hit_weight", _section_weight(F.coalesce("held", F.lit(0).cast("bigint")), names)).join(total, "doc_id", "left")
    share = lambda g: F.when(F.col(f"n_{g}") > 0, F.col(f"hit_{g}") / F.col(f"n_{g}")).otherwise(0.0)
    rows = rows.withColumns({"must": share("must"), "nice": share("nice"), "position_share": share("position"), "evidence": F.coalesce(F.col("hit_weight") / F.col("all_weight"), F.lit(0.0))})
    a, b, c = weights(request)
    score = a * (0.55 * F.col("must") + 0.2 * F.col("nice") + 0.25 * F.col("position_share")) + b * F.col("evidence") + (c * F.col("context") if c else F.lit(0.0))
    return rows.select("doc_id", "job_id", "hits", "must", "nice", "position_share", "evidence", "context", score.alias("score"))


def pair_score(docs: DataFrame, jobs: DataFrame, section_hits: DataFrame, sections: DataFrame, request: str = "", names: Sequence[str] = SECTION_NAMES) -> DataFrame:
    """H13. Coverage of must, nice and position terms, sections that hold a hit, and the score of each pair with a hit.

    r = .55 must + .20 nice + .25 position; s = weight of the sections with a hit over that of all; score .8 r + .2 s, or with a request
    .65 r + .15 s + .2 c, where c is the posting's terms that hold a word of the request over the request's words (8 at most). Not clamped.
    Pairs without a hit score .2 c, whatever the document: with_context() adds them, rank_for_request() those that can be among the best.
    section_hits: (doc_id, section, term); sections: (doc_id, section). Sections are bits of a number, one for each of `names` (62 at most);
    sections of other names count as one together. What is shuffled is one row for each hit of a document: they meet by doc_id before they
    fan out to the postings, so that pairs are summed where they arise (rank_jobs needs no further shuffle), as long as the postings'
    terms are broadcast; where they are too many for that, Spark joins them by term.
    """
    terms = posting_terms(jobs, request)
    return scored(held_terms(docs, terms.select("term"), section_hits, names, pair_parts(docs, jobs)).join(terms.drop("share"), "term"), sections, request, names)


def full_list(docs: DataFrame, jobs: DataFrame, section_hits: DataFrame, sections: DataFrame, request: str, names: Sequence[str] = SECTION_NAMES, most: int = 10_000) -> DataFrame:
    """C10, H13. The rows of with_context(pair_score()) in the pass that sums the pairs: a document meets the postings that the request touches by NO_TERM, which counts
    nothing, so that pairs are neither made twice nor shuffled to be told from those without a hit."""
    if context_postings(jobs, request).limit(most + 1).count() > most:
        raise ValueError(f"a request touches over {most} postings; rank_for_request() gives the best without listing all")
    terms = posting_terms(jobs, request)
    sizes = term_groups(jobs).select("job_id", F.lit(NO_TERM).alias("term"), *(F.lit(0).alias(f"is_{g}") for g in KINDS), *(F.size(f"t_{g}").alias(f"n_{g}") for g in KINDS), context_share(request).alias("context"))
    held = held_terms(docs, terms.select("term"), section_hits, names, pair_parts(docs, jobs), listed=True)
    return scored(held.join(terms.drop("share").unionByName(sizes.where("context > 0")), "term"), sections, request, names)


def context_postings(jobs: DataFrame, request: str) -> DataFrame:
    """C10. job_id and context of the postings that a request touches."""
    return term_groups(jobs).select("job_id", context_share(request).alias("context")).where("context > 0")


def _listed(docs: DataFrame, postings: DataFrame, request: str, most: int) -> DataFrame:
    """Each document with each of the postings (`most` at most, else an error), as a pair without a hit."""
    kind = postings.schema["job_id"].dataType.simpleString()
    rows = postings.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a request touches over {most} postings; rank_for_request() gives the best without listing all")
    listed = F.from_json(F.lit(json.dumps([r.asDict() for r in rows])), f"array<struct<job_id: {kind}, context: double>>")
    zero = (F.lit(0.0).alias(n) for n in ("must", "nice", "position_share", "evidence"))
    return docs.select("doc_id", F.explode(listed).alias("p")).select("doc_id", "p.job_id", F.lit(0).cast("bigint").alias("hits"), *zero, "p.context", (weights(request)[2] * F.col("p.context")).alias("score"))


def with_context(pairs: DataFrame, docs: DataFrame, jobs: DataFrame, request: str, most: int = 10_000) -> DataFrame:
    """C10, H13. pairs (of pair_score), and those without a hit that score for their posting's context: documents times the postings that the request touches, which is what the
    full list is; over `most` such postings are an error."""
    more = _listed(docs, context_postings(jobs, request), request, most)
    return pairs.unionByName(more.join(pairs.select("doc_id", "job_id"), ["doc_id", "job_id"], "left_anti"))


def rank_for_request(pairs: DataFrame, docs: DataFrame, jobs: DataFrame, request: str, k: int = 5, min_score: float = 0.08) -> DataFrame:
    """E1. As rank_jobs of with_context(), which is not made: postings are ranked by context once. Whichever of the k best of these a document has no hit in scores
    its context alone, and one with a hit no less; so any beyond them has k better ones. Each document gets those k, and its k best hits.
    """
    best = context_postings(jobs, request).orderBy(F.desc("context"), "job_id").limit(k)
    w = Window.partitionBy("doc_id").orderBy(F.round("score", 9).desc(), F.desc("hits"), "job_id")
    top = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    both = top.unionByName(_listed(docs, best, request, k))
    # a posting that is among both counts with its hits; one whose hits are not among the best is behind k others anyway
    once = Window.partitionBy("doc_id", "job_id").orderBy(F.desc("hits"))
    return rank_jobs(both.repartition(pair_parts(docs, jobs), "doc_id").withColumn("n", F.row_number().over(once)).where("n = 1").drop("n"), k, min_score)


def top_jobs(docs: DataFrame, jobs: DataFrame, section_hits: DataFrame, sections: DataFrame, k: int = 5, min_score: float = 0.08, first: int = 6, request: str = "", names: Sequence[str] = SECTION_NAMES) -> DataFrame:
    """E1. As rank_jobs(pair_score()), with bounds before ranks: bounded() tells which terms open postings, and only pairs that may be among a document's k best are scored.
    Hits meet by document once; bounds, sums and ranks come from these partitions, and no pair is shuffled."""
    terms = posting_terms(jobs, request)
    hits = bounded(held_terms(docs, terms.select("term"), section_hits, names, pair_parts(docs, jobs)), terms, sections, k, first, request, names)
    return rank_jobs(scored(hits.join(terms, "term"), sections, request, names, _bounds(), _may(request)), k, min_score)


def _reach(share: Column, request: str) -> Column:
    """What a posting scores at most with this share, all evidence and context; a little room for sums in another order."""
    a, b, c = weights(request)
    return a * share + b + c + 1e-9


def _bounds() -> tuple[Column, ...]:
    """Of a pair: whether a term opens it, its share of those that do, the weights of all others and the document's floor."""
    return F.bool_or("opens").alias("opens"), F.sum(F.when(F.col("opens"), F.col("share")).otherwise(0.0)).alias("opened"), F.max("later").alias("later"), F.max("floor").alias("floor")


def _may(request: str) -> Column:
    return F.col("opens") & (_reach(F.col("opened") + F.col("later"), request) >= F.col("floor"))


def candidates(hits: DataFrame, terms: DataFrame, sections: DataFrame, k: int, first: int, request: str = "", names: Sequence[str] = SECTION_NAMES) -> DataFrame:
    """Pairs (doc_id, job_id) that may be among a document's k best, by bounded()."""
    rows = bounded(hits, terms, sections, k, first, request, names).where("opens").join(terms.select("term", "job_id", "share"), "term")
    return rows.groupBy("doc_id", "job_id").agg(*_bounds()).where(_may(request)).select("doc_id", "job_id")


def bounded(hits: DataFrame, terms: DataFrame, sections: DataFrame, k: int, first: int, request: str = "", names: Sequence[str] = SECTION_NAMES) -> DataFrame:
    """hits (doc_id, term, held) with `opens`, whether the term opens postings, `later`, the weights of those that do not, and `floor`, which a score among the document's k best reaches.

    A term's weight is its greatest share in any posting. In order of weight, a document's `first` terms give partial scores, with the evidence of the sections where they stand, whose k-th is a floor. A posting that holds none of the
    terms before the i-th scores at most what the weights from the i-th on add up to, with all evidence and context: once that is below the floor, the terms from there on open no
    posting; and one that earlier terms opened is dropped if its share of them and all later weights stay below. Hits that are partitioned by doc_id stay where they are.
    """
    a, b, c = weights(request)
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    most = terms.groupBy("term").agg(F.max("share").alias("weight"))
    total = sections.groupBy("doc_id").agg(_section_weight(F.bit_or(_section_bit(F.col("section"), names)), names).alias("all_weight"))
    # the same rows in both uses, so that Spark makes their shuffle once
    ranked = hits.where("doc_id IS NOT NULL").select("doc_id", "term", "held").join(most, "term").withColumn("place", F.row_number().over(order)).withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    partial = ranked.where(F.col("place") <= first).join(terms.select("term", "job_id", "share", "context"), "term").groupBy("doc_id", "job_id").agg((a * F.sum("share") + c * F.max("context")).alias("sums"), F.bit_or("held").alias("held")).join(total, "doc_id", "left")
    evidence = F.coalesce(_section_weight(F.coalesce("held", F.lit(0).cast("bigint")), names) / F.col("all_weight"), F.lit(0.0))
    partial = partial.select("doc_id", (F.col("sums") + b * evidence).alias("partial"))
    floor = partial.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("partial")))).where(F.col("n") == k).select("doc_id", F.col("partial").alias("floor"))
    known = ranked.join(floor, "doc_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).withColumn("opens", _reach(F.col("rest"), request) >= F.col("floor"))
    return known.withColumn("later", F.sum(F.when(~F.col("opens"), F.col("weight")).otherwise(0.0)).over(Window.partitionBy("doc_id"))).select("doc_id", "term", "held", "opens", "later", "floor")


def rank_jobs(scored: DataFrame, k: int = 5, min_score: float = 0.08) -> DataFrame:
    """E1. The best k postings of each document by score and hits; below the least score only the first stays; percent is held to 0..100."""
    w = Window.partitionBy("doc_id").orderBy(F.round("score", 9).desc(), F.desc("hits"), "job_id")
    ranked = scored.where((F.col("hits") > 0) | (F.col("score") > 0)).withColumn("rank", F.row_number().over(w))
    kept = ranked.where((F.col("rank") <= k) & ((F.col("score") >= min_score) | (F.col("rank") == 1)))
    return kept.withColumn("percent", F.least(F.greatest(F.col("score") * 100, F.lit(0.0)), F.lit(100.0)))


def accept_auto() -> Column:
    """H26. Whether a match without request is strong enough to be taken by itself."""
    enough = (F.col("position_share") >= 0.5) & (F.col("must") >= 0.34)
    return enough | ((F.col("must") >= 0.6) & ((F.col("hits") >= 2) | (F.col("position_share") > 0)))


def select_job(ranked: DataFrame, requests: DataFrame, least: float = 0.22) -> DataFrame:
    """H26. The first posting of each document: accepted above `least` where the document asks for one (request <> ''), else recommended only."""
    first = ranked.where("rank = 1").join(requests, "doc_id", "left")
    asked = F.coalesce("request", F.lit("")) != ""
    decision = F.when(asked & (F.col("score") >= least), "accepted").when(asked, "rejected").otherwise("recommended")
    return first.select("doc_id", "job_id", "score", decision.alias("decision"), accept_auto().alias("strong"))


def requirement_basis(first: DataFrame, docs: DataFrame, jobs: DataFrame, most: int = 8) -> DataFrame:
    """H26. What the postings of `first` (doc_id, job_id) ask for and the documents show: skills hit and missing, `most` of each in the posting's
    order, and how many; a skill is hit where a term that the document holds contains it or is contained in it. A posting without skills: both empty.
    """
    groups = term_groups(jobs).select("job_id", clean_skills(F.col("must")).alias("skills"), "t_all")
    asked = first.select("doc_id", "job_id").join(groups, "job_id")
    hits = match_terms(docs, groups.select(F.explode("t_all").alias("term")), once=False).repartition(pair_parts(docs, jobs), "doc_id")
    rows = asked.join(hits.groupBy("doc_id").agg(F.collect_set("term").alias("held")), "doc_id", "left").withColumn("held", F.coalesce(F.array_intersect("t_all", "held"), F.array().cast("array<string>")))
    hit = F.filter("skills", lambda s: F.exists("held", lambda t: F.contains(F.lower(s), t) | F.contains(t, F.lower(s))))
    rows = rows.withColumn("hit", hit).withColumn("missing", F.array_except("skills", "hit"))
    return rows.select("doc_id", "job_id", F.slice("hit", 1, most).alias("hit_skills"), F.slice("missing", 1, most).alias("missing_skills"), F.size("hit").alias("hit_count"), F.size("missing").alias("miss_count"))


def alignment(pairs: DataFrame, docs: DataFrame, jobs: DataFrame, degrees: Sequence[tuple[str, int, str]], experience: str) -> DataFrame:
    """H14. Whether a document meets a posting's degree and shows experience."""
    low = F.lower("text")
    ranks = docs.select("doc_id", F.coalesce(F.array_max(F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(r)) for _, r, p in degrees)))), F.lit(0)).alias("rank"), low.rlike(experience).alias("shown"))
    need = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for n, r, _ in degrees for x in (n, r))), F.col("education")), F.lit(0))
    rows = pairs.join(ranks, "doc_id").join(jobs.select("job_id", need.alias("need"), (F.col("experience") != "").alias("wants")), "job_id")
    education = F.when(F.col("need") == 0, "not_required").when(F.col("rank") >= F.col("need"), "meets").otherwise("unknown")
    return rows.select("doc_id", "job_id", education.alias("education"), F.when(~F.col("wants"), "not_required").when(F.col("shown"), "evidence_found").otherwise("unknown").alias("experience"))


def job_words(text: Column, stop_words: Sequence[str], terms: Sequence[str] = (), most: int = 18) -> Column:
    """H22. must: the words of a posting and the known terms in it, without stop words, the longest first, `most` of them; nice: terms of over 16 characters. Null: null."""
    low, terms = F.lower(text), sorted({t.strip().lower() for t in terms} - {""})
    none = F.array().cast("array<string>")
    known = lambda kept: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in kept))) if kept else none
    found = F.concat(F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9+#.]{1,}"), F.lit(0)), known([t for t in terms if len(t) <= 16 and t not in COMMON_TERMS]))
    words = F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop_words)) if stop_words else none)
    keyed = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    nice = known([t for t in terms if len(t) > 16 and t not in stop_words])
    return F.when(text.isNotNull(), F.struct(F.slice(F.transform(keyed, lambda x: x["w"]), 1, most).alias("must"), nice.alias("nice")))


def pick_profile(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """H22. The profile whose aliases in a text are longest together; ties by name. profiles: (profile, alias)."""
    hits = match_terms(docs, profiles.select(F.col("alias").alias("term")))
    rows = hits.join(profiles.select("profile", F.lower(F.trim("alias")).alias("term")), "term").groupBy("doc_id", "profile").agg(F.sum(F.length("term")).alias("n"))
    return rows.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "profile")).alias("b")).select("doc_id", F.col("b.profile").alias("profile"))


def rule_score(rows: DataFrame) -> DataFrame:
    """H23. From expected, hits, must_hits, must_misses, has_profile, strong_hits and weak_only: the score 30..100."""
    n = lambda c: F.col(c)
    s = F.round(F.least(F.greatest(100.0 * n("hits") / F.greatest(n("expected"), F.lit(1)), F.lit(30.0)), F.lit(100.0)))
    s = F.when(n("must_hits") > 0, F.least(F.lit(100.0), s + F.least(F.lit(8), 2 * n("must_hits")))).otherwise(s)
    s = F.when(n("must_misses") > 0, F.greatest(F.lit(30.0), s - F.least(F.lit(12), 3 * n("must_misses")))).otherwise(s)
    s = F.when(n("has_profile") & (n("hits") > 0), F.least(F.lit(100.0), s + 4)).otherwise(s)
    s = F.when(n("strong_hits") > 0, F.least(F.lit(100.0), s + F.least(F.lit(6), n("strong_hits")))).otherwise(s)
    weak = (n("weak_only") > 0) & (n("weak_only") >= F.greatest(F.lit(1), F.floor(n("hits") / 2)))
    s = F.when(weak, F.greatest(F.lit(30.0), s - F.least(F.lit(8), 2 * n("weak_only")))).otherwise(s)
    return rows.withColumn("rule_score", F.when(n("expected") == 0, 50.0).otherwise(s))


def rule_features(docs: DataFrame, jobs: DataFrame, section_hits: DataFrame) -> DataFrame:
    """H23. Of each pair with a hit what rule_score asks for."""
    terms = job_terms(jobs).where("is_must + is_nice > 0")
    section, none = F.col("section"), F.lit(None).cast("boolean")
    stands = section_hits.select("doc_id", "term", F.lit(False).alias("hit"), section.isin(*STRONG).alias("strong"), section.isin(*WEAK_SECTIONS).alias("listed"), section.isNotNull().alias("there"))
    rows = match_terms(docs, terms.select("term"), once=False).select("doc_id", "term", F.lit(True).alias("hit"), *(none.alias(c) for c in ("strong", "listed", "there"))).unionByName(stands)
    held = rows.repartition(pair_parts(docs, jobs), "doc_id").groupBy("doc_id", "term").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("hit", "strong", "listed", "there"))).where("hit")
    flagged = held.join(terms, "term").withColumn("weak", F.col("there") & ~F.col("listed"))
    sums = flagged.groupBy("doc_id", "job_id").agg(F.count("*").alias("hits"), F.sum("is_must").alias("must_hits"), F.count_if("strong").alias("strong_hits"), F.count_if("weak").alias("weak_only"))
    sizes = term_groups(jobs).select("job_id", F.size("t_must").alias("n_must"), F.size(F.array_union("t_must", "t_nice")).alias("expected"), (F.col("category") == "cat-1").alias("has_profile"))
    return sums.join(sizes, "job_id").withColumn("must_misses", F.col("n_must") - F.col("must_hits"))


def degree_gate(rows: DataFrame, rank: str = "rank", need: str = "need") -> Column:
    """H24. pass, fail or unknown of the hard constraint on degrees; unknown where a side names none."""
    return F.when((F.col(need) == 0) | (F.col(rank) == 0), "unknown").when(F.col(rank) >= F.col(need), "pass").otherwise("fail")


def final_score(gate: Column, semantic: Column, rule: Column) -> Column:
    """H24. A failed constraint gives 0; else the semantic score where there is one; else the rules' score."""
    return F.when(gate == "fail", 0.0).when(semantic.isNotNull(), F.round(semantic)).otherwise(rule)


def coverage_breakdown(keyword: Column, skills: Column, sections: Column) -> Column:
    """H25. .55 keywords + .25 skills + .20 of the section checklist, in percent. sections: array of those there."""
    has = lambda *s: F.arrays_overlap(sections, F.array(*map(F.lit, s))).cast("double")
    checklist = (has("education") + has("internship", "projects", "campus") + has("skills") + has("summary", "basic_info")) / 4
    return 100 * (0.55 * keyword + 0.25 * skills + 0.2 * checklist)


def resolve_inputs(df: DataFrame) -> DataFrame:
    """B10. Position and description: the profile's, with what was asked for as a fallback for the position and in front for the description."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return df.withColumn("position", F.coalesce(blank("profile_name"), blank("asked_position"), F.lit(""))).withColumn("description", F.coalesce(blank("profile_description"), blank("asked_description"), F.lit("")))


def resolve_target(df: DataFrame) -> DataFrame:
    """B11. Target and its source: an override, what was given by hand, what was detected if that is allowed, else generic."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    source = F.when(filled("override"), F.col("override")).when(filled("manual"), "manual").when(F.col("allow_detected") & filled("detected"), "detected").otherwise("generic")
    target = F.when(filled("manual"), F.trim("manual")).when(F.col("allow_detected") & filled("detected"), F.trim("detected")).otherwise("")
    return df.withColumn("target", target).withColumn("source", source)


def evidence_snippets(section_lines: DataFrame, hits: DataFrame, n: int = 6) -> DataFrame:
    """E10. The n best lines of a document that hold hit terms: 2 a term + min(length / 40, 2) + the section's bonus + 0.3; lines of contacts or under 8 characters are out.

    hits: (doc_id, term). Without such lines the first lines of the body stand in, with score 0. Lines meet their document's hits, by doc_id, and are looked at for these alone.
    """
    lines = section_lines.where((F.length(F.trim("line")) >= 8) & ~F.col("line").rlike(r"^\s*[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\s*$"))
    own = hits.where((F.col("term") == F.lower(F.trim("term"))) & (F.col("term") != "")).groupBy("doc_id").agg(F.collect_list("term").alias("own"))
    low = F.col("low")
    rows = lines.withColumn("low", F.lower("line")).join(own, "doc_id", "left").withColumn("held", F.filter("own", lambda t: F.contains(low, t)))
    whole = lambda t: t.rlike(WORDLIKE)
    rows = rows.withColumn("words", F.when(F.exists("held", whole), runs(low)))
    rows = rows.withColumn("terms", F.size(F.filter("held", lambda t: F.when(whole(t), F.array_contains("words", t)).otherwise(True)))).drop("low", "own", "held", "words")
    bonus = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in SNIPPET_BONUS.items() for x in p)), F.col("section")), F.lit(0.0))
    score = 2 * F.col("terms") + F.least(F.length(F.trim("line")) / 40, F.lit(2.0)) + bonus + 0.3
    rows = rows.withColumn("score", F.when(F.col("terms") > 0, score).otherwise(F.lit(0.0)))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "line_no")
    ranked = rows.withColumn("place", F.row_number().over(w)).withColumn("best", F.max("score").over(Window.partitionBy("doc_id")))
    return ranked.where((F.col("place") <= n) & ((F.col("score") > 0) | (F.col("best") == 0))).select("doc_id", "line_no", "section", "score", "place")


#: What a row of skill_hints tells of a hint, in this order.
HELD, PARENT, MISSING = range(-1, 2)


def skill_hints(hits: DataFrame, edges: DataFrame, missing: DataFrame, limit: int = 5) -> DataFrame:
    """C11. Parents that a document lacks of skills it has, then missing keywords; `limit` in all. hits: (doc_id, term); edges: (parent, child); missing: (doc_id, term, rank)."""
    parents = edges.groupBy("child").agg(F.collect_set("parent").alias("parents")).withColumnRenamed("child", "term")
    kind = lambda k, hint: F.struct(hint.alias("hint"), F.lit(k).alias("kind"))
    held = F.array(kind(HELD, F.col("term")))
    found = hits.join(parents, "term", "left").select("doc_id", F.inline(F.when(F.col("parents").isNull(), held).otherwise(F.concat(held, F.transform("parents", lambda p: kind(PARENT, p))))))
    more = missing.select("doc_id", F.col("term").alias("hint"), F.lit(MISSING).alias("kind"), F.col("rank").cast("int").alias("rank"))
    rows = found.withColumn("rank", F.lit(0)).unionByName(more).repartition("doc_id")
    # of a document and hint: first what it holds, then parents, of which one row counts, then what is missing
    hint = Window.partitionBy("doc_id", "hint").orderBy("kind")
    has = lambda k: F.coalesce(F.max((F.col("kind") == k) & F.col("doc_id").isNotNull()).over(Window.partitionBy("doc_id", "hint")), F.lit(False))
    rows = rows.withColumns({"before": F.lag("kind").over(hint), "held": has(HELD), "parent": has(PARENT)})
    rows = rows.where(((F.col("kind") == PARENT) & ~F.col("held") & (F.coalesce("before", F.lit(HELD)) == HELD)) | ((F.col("kind") == MISSING) & (F.col("held") | ~F.col("parent"))))
    w = Window.partitionBy("doc_id").orderBy("kind", "rank", "hint")
    reason = F.when(F.col("kind") == PARENT, "skill_graph").otherwise("missing")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("doc_id", "hint", reason.alias("reason"), "place")


def recommend_templates(found: DataFrame, catalog: DataFrame, n: int = 3) -> DataFrame:
    """C13. The n best templates of a small catalog (template, wants_section, min_size, base) for each document; the fallback row always counts 0."""
    rows = found.crossJoin(F.broadcast(catalog))
    score = F.col("base") + F.when(F.array_contains("sections", F.col("wants_section")), 2.0).otherwise(0.0) + F.when(F.col("size") >= F.col("min_size"), 1.0).otherwise(-1.0)
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "template")
    return rows.withColumn("score", score).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("doc_id", "template", "score", "place")


def apply_rewrites(lines: DataFrame, replacements: DataFrame, hints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C12. Lines with their replacements, and what changed: rewrite where the normal forms are equal, append_rewrite where no line matches, skill_graph for hints that no line of the document holds.

    replacements: (doc_id, old, new); hints: (doc_id, hint). Of several replacements for a line the smallest new text counts.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    new = replacements.groupBy("doc_id", norm("old").alias("key")).agg(F.min("new").alias("new"))
    keyed = lines.withColumn("key", norm("line"))
    joined = keyed.join(new, ["doc_id", "key"], "left")
    out = joined.select("doc_id", "line_no", F.coalesce("new", "line").alias("line"))
    changed = joined.where("new IS NOT NULL").select("doc_id", F.lit("rewrite").alias("change"), F.col("new").alias("text"))
    appended = new.join(keyed.select("doc_id", "key"), ["doc_id", "key"], "left_anti").select("doc_id", F.lit("append_rewrite").alias("change"), F.col("new").alias("text"))
    held = hints.join(lines, "doc_id").where(contains_word(F.lower("line"), F.lower("hint"))).select("doc_id", "hint")
    added = hints.join(held, ["doc_id", "hint"], "left_anti").select("doc_id", F.lit("skill_graph").alias("change"), F.col("hint").alias("text"))
    return out, changed.unionByName(appended).unionByName(added)


def contains_word(text: Column, word: Column) -> Column:
    return F.array_contains(F.regexp_extract_all(text, F.lit(r"[a-z0-9+#.]+"), F.lit(0)), word)


