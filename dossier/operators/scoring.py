"""Scores of documents: six dimensions, penalties and caps, advice; profiles of entries, dates and skills."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import CORE_SECTIONS, DEFAULT_WEIGHTS, DIMENSIONS, RuleSet
from ..functions.text import date_range, meets
from .lines import DATE


def normalise_weights(weights: Column) -> Column:
    """H15. Weights that sum to 1, 4 digits; none or a sum of 0 gives the default ones."""
    known = F.map_filter(weights, lambda k, v: k.isin(*DIMENSIONS) & (v > 0))
    total = F.aggregate(F.map_values(known), F.lit(0.0), lambda s, x: s + x)
    default = F.create_map(*(F.lit(x) for p in DEFAULT_WEIGHTS.items() for x in p))
    return F.when(F.coalesce(total, F.lit(0.0)) > 0, F.transform_values(known, lambda k, v: F.round(v / total, 4))).otherwise(default)


def resolve_weights(rows: DataFrame, templates: DataFrame, active: str = "") -> DataFrame:
    """H15. The weights of each row's profile, else of the active template, else the default. templates: (template, weights map)."""
    own = templates.select(F.col("template").alias("profile"), F.col("weights").alias("own"))
    now = templates.where(F.col("template") == active).agg(F.first("weights").alias("now"))
    joined = rows.join(F.broadcast(own), "profile", "left").crossJoin(F.broadcast(now))
    return joined.withColumn("weights", normalise_weights(F.coalesce("own", "now", F.create_map().cast("map<string,double>")))).drop("own", "now")


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _cap(c: Column, low: Column, most: float) -> Column:
    return F.when(low, F.least(c, F.lit(most))).otherwise(c)


def section_counts(section_lines: DataFrame) -> DataFrame:
    """Lines of each section of a document, mean line length and dates, as columns."""
    n = lambda s: F.count_if(F.col("section") == s).alias(f"n_{s}")
    return section_lines.groupBy("doc_id").agg(*(n(s) for s in (*CORE_SECTIONS, "campus", "awards", "summary")), F.count("*").alias("n_lines"), F.avg(F.length("line")).alias("mean_length"), F.bool_or(F.col("line").rlike(DATE)).alias("any_date"))


def score_documents(found: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """H18. From counts, evidence, quality, contact, complexity and job_match (0..100): the six scores, penalty, total, reliability and coverage."""
    n, low = F.col, F.col("quality") == "low"
    at_most = lambda c, k: F.least(F.col(c), F.lit(k))
    missing = sum((F.when(n(f"n_{s}") == 0, 1).otherwise(0) for s in CORE_SECTIONS), F.lit(0))
    completeness = 35 + sum((F.when(n(f"n_{s}") >= 4, 13).when(n(f"n_{s}") > 0, 8).otherwise(0) for s in CORE_SECTIONS), F.lit(0)) + F.when(n("n_awards") > 0, 4).otherwise(0) + F.when(n("n_campus") > 0, 3).otherwise(0)
    completeness = F.when(low, F.least(completeness, F.lit(52))).otherwise(completeness - F.when(missing >= 3, 8).otherwise(0))
    experience = 42 + 3 * at_most("exp_lines", 12) + 4 * at_most("actions", 6) + 6 * at_most("metrics", 5) + 4 * at_most("results", 5) + F.when((n("n_internship") > 0) & (n("n_projects") > 0), 6).otherwise(0)
    experience = _cap(experience - F.when((n("exp_lines") == 0) & ~low, 12).otherwise(0), low, 50)
    language = _cap(62 + 4 * at_most("actions", 7) + 3 * at_most("results", 4) - 5 * at_most("vague", 5) - 3 * at_most("long", 5), low, 55)
    sections = sum((F.when(n(f"n_{s}") > 0, 1).otherwise(0) for s in (*CORE_SECTIONS, "campus", "awards", "summary")), F.lit(0))
    shape = F.when(n("n_lines") == 0, 55).otherwise(78) - F.when(n("mean_length") > 85, 12).otherwise(0) - F.when(n("n_lines") < 8, 14).otherwise(0) + F.when(sections >= 5, 8).otherwise(0) + F.when(n("has_contact"), 6).otherwise(0) + F.when(n("any_date"), 4).otherwise(0)
    highlights = _cap(45 + 7 * at_most("metrics", 6) + 5 * at_most("results", 5) + F.when(n("metrics") > 0, 6).when(~low, -8).otherwise(0), low, 50)
    rows = found.withColumns({
        "s_content_completeness": _clamp(completeness, 35, 100), "s_experience_match": _clamp(experience, 35, 100), "s_language_professionalism": _clamp(language, 35, 100), "s_format_standardization": _clamp(shape, 30, 100),
        "s_highlight_strength": _clamp(highlights, 35, 100), "s_job_match": F.col("job_match"),
    })
    strong = (n("duty_zones") > 0) & ((n("s_job_match") >= 65) | (n("s_experience_match") >= 65)) & (n("confidence") < 0.55)
    mild = (F.size("zones") > 0) & (n("confidence") < 0.45)
    p = F.when(strong, F.least(F.lit(10), 3 + 2 * n("duty_zones"))).otherwise(F.lit(0))
    q = F.when(strong, F.greatest(F.lit(2), F.floor(p / 2))).when(mild, F.least(F.lit(6), F.greatest(F.lit(2), 2 * n("duty_zones")))).otherwise(F.lit(0))
    rows = rows.withColumn("penalty_experience", p).withColumn("penalty_highlights", q)
    rows = rows.withColumn("s_experience_match", n("s_experience_match") - n("penalty_experience")).withColumn("s_highlight_strength", n("s_highlight_strength") - n("penalty_highlights"))
    total = F.round(sum((F.lit(w) * n(f"s_{d}") for d, w in weights.items()), F.lit(1e-9)), 1)
    rows = rows.withColumns({f"s_{d}": _cap(n(f"s_{d}").cast("double"), low, 62.0) for d in DIMENSIONS} | {"total": _cap(total, low, 58.0)})
    share = sum((F.when(n(f"n_{s}") > 0, 0.25).otherwise(0.0) for s in ("education", "internship", "projects", "skills")), F.lit(0.0))
    coverage = F.round(_clamp(F.when(n("has_target"), 0.5 * share + 0.3 * n("match_rate") + 0.2 * n("confidence")).otherwise(share), 0.0, 1.0), 3)
    reliability = F.when(low, "low_parse_capped").when(n("complexity") >= 3.5, "layout_review").when(coverage < 0.5, "evidence_review").otherwise("normal")
    return rows.withColumn("coverage", coverage).withColumn("reliability", reliability)


#: Advice codes: what is wrong, and the condition on a scored row.
ADVICE = (
    ("no_metrics", "metrics = 0 AND exp_lines > 0"), ("few_actions", "actions < 2 AND exp_lines > 0"), ("vague_wording", "vague >= 2"), ("long_lines", "long >= 3"), ("missing_education", "n_education = 0"), ("missing_skills", "n_skills = 0"),
    ("no_contact", "NOT has_contact"), ("low_parse", "quality = 'low'"), ("weak_match", "job_match < 50"), ("layout", "complexity >= 3.5"),
)


def advice(scored: DataFrame, n: int = 5) -> DataFrame:
    """H19. Codes of what to mend, in fixed order, and the first n as a roadmap."""
    codes = F.array_compact(F.array(*(F.when(F.expr(when), F.lit(code)) for code, when in ADVICE)))
    return scored.select("doc_id", codes.alias("codes")).withColumn("roadmap", F.slice("codes", 1, n))


#: H19. Items a list of advice has at most; weak lines and missing keywords named, matched ones, and items from which no more of these come.
MOST_ITEMS, NAMED_WEAK, NAMED_MISSING, NAMED_HITS, ENOUGH = 8, 2, 3, 2, 6


def advice_items(scored: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """H19. doc_id and items (problem, evidence, direction): what to mend, each with the line, keyword or figure that shows it, in fixed order, `most` at most.

    scored: rows of score_documents with evidence() (weak_lines, metrics) and two arrays, missing_keywords and hit_keywords. A document that could hardly be read has only that item. Otherwise: the
    first weak lines, the first missing keywords, those that are there (fewer once six items are listed), few metrics, and each dimension below 60 with what stands for it. Equal items count once; without any: complete.
    Null arrays are empty.
    """
    rows = scored.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("missing_keywords", "hit_keywords")})
    item = lambda problem, evidence, direction: F.struct(F.lit(problem).alias("problem"), evidence.cast("string").alias("evidence"), F.lit(direction).alias("direction"))
    each = lambda c, k, problem, direction: F.transform(F.slice(c, 1, k), lambda x: item(problem, x, direction))
    none = F.array().cast("array<struct<problem: string, evidence: string, direction: string>>")
    rows = rows.withColumn("named", F.concat(each("weak_lines", NAMED_WEAK, "no_result", "tell_result"), each("missing_keywords", NAMED_MISSING, "missing_keyword", "use_keyword")))
    hits = F.least(F.lit(NAMED_HITS), F.greatest(F.lit(1), ENOUGH - F.size("named")))
    few = F.when(F.col("metrics") < 2, F.array(item("few_metrics", F.col("metrics"), "add_metrics"))).otherwise(none)
    rows = rows.withColumn("named", F.concat("named", each("hit_keywords", hits, "matched_keyword", "move_forward"), few))
    shown = {
        "experience_match": F.try_element_at("weak_lines", F.lit(1)).cast("string"), "highlight_strength": F.col("metrics").cast("string"), "job_match": F.nullif(F.array_join(F.slice("missing_keywords", 1, NAMED_MISSING), ","), F.lit("")),
    }
    points = lambda d: F.floor(F.col(f"s_{d}")).cast("string")
    low = F.array_compact(F.array(*(F.when(F.col(f"s_{d}") < 60, item(f"low_{d}", F.coalesce(shown.get(d, points(d)), points(d)), "fill_section")) for d in DIMENSIONS)))
    all_items = F.slice(F.array_distinct(F.concat("named", F.slice(low, F.lit(1), F.greatest(F.lit(0), most - F.size("named"))))), 1, most)
    items = F.when(F.col("quality") == "low", F.array(item("no_text", F.lit(""), "save_as_text"))).when(F.size(all_items) == 0, F.array(item("complete", F.lit(""), "tune"))).otherwise(all_items)
    return rows.select("doc_id", items.alias("items"))


def rewrite_candidates(section_lines: DataFrame, rules: RuleSet, caps: Mapping[str, int] | None = None) -> DataFrame:
    """H19. Experience lines worth rewriting by kind (no_metric, vague, long), at most so many of each kind, first ones first; a line counts once."""
    caps = caps or {"vague": 3, "long": 2, "no_metric": 3}
    low = F.lower("line")
    kind = F.when(low.rlike(rules.vague), "vague").when(F.length("line") > 90, "long").when(~low.rlike(r"[0-9]"), "no_metric")
    rows = section_lines.where(F.col("section").isin("internship", "projects", "campus")).withColumn("kind", kind).where("kind IS NOT NULL")
    w = Window.partitionBy("doc_id", "kind").orderBy("line_no")
    most = F.element_at(F.create_map(*(F.lit(x) for p in caps.items() for x in p)), F.col("kind"))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("doc_id", "line_no", "kind", "place")


def merged_months(intervals: DataFrame) -> DataFrame:
    """E13. Months that the intervals (person_id, start_m, end_m; both inclusive) of a person cover, overlapping and adjoining ones merged."""
    w = Window.partitionBy("person_id").orderBy("start_m", "end_m", "seq")
    good = intervals.where(F.col("end_m") >= F.col("start_m"))
    seen = F.max("end_m").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = good.withColumn("opens", F.when(seen.isNull() | (F.col("start_m") - seen > 1), 1).otherwise(0)).withColumn("island", F.sum("opens").over(w))
    spans = islands.groupBy("person_id", "island").agg((F.max("end_m") - F.min("start_m") + 1).alias("months"))
    return spans.groupBy("person_id").agg(F.sum("months").alias("months"), F.count("*").alias("spans"))


#: Schools by their last word, and subjects by a label or the word for them.
SCHOOL = r"(?:[A-Z][A-Za-z0-9_. ]{2,40}(?:University|College|School)|[A-Za-z\x{4e00}-\x{9fa5}]{2,30}(?:大学|学院|学校|职业技术学院|职业技术大学))"
MAJOR = r"([A-Za-z\x{4e00}-\x{9fa5}]{2,24}专业)|(?:专业|Major)[:：]\s*([A-Za-z\x{4e00}-\x{9fa5}]{2,24})"
RANGE = r"(?i)[0-9]{4}(?:[./-][0-9]{1,2})?\s*(?:-|to|until)\s*(?:[0-9]{4}(?:[./-][0-9]{1,2})?|present|now|today)"
EDGES = r"^[ ，,|-]+|[ ，,|-]+$"


def education_entries(section_lines: DataFrame, rules: RuleSet, as_of: str) -> DataFrame:
    """H28. Of each education line with a degree, a school or a range: school, degree, major, range and confidence.

    The major is named as such, or is what follows the school without degree and range, where that has 2 to 24 characters and tells of no duty or award.
    """
    low = F.lower("line")
    degree, rest = F.lit(""), F.regexp_replace(F.regexp_extract("line", rf"{SCHOOL}(.*)$", 1), RANGE, "")
    for name, _, pattern in reversed(rules.degrees):
        degree = F.when(meets(low, pattern), name).otherwise(degree)
    for _, _, pattern in rules.degrees:
        rest = F.regexp_replace(rest, rf"(?i){pattern}", "")
    rows = section_lines.where(F.col("section") == "education").withColumns({
        "school": F.trim(F.regexp_extract("line", SCHOOL, 0)), "degree": degree, "range": date_range(F.col("line"), as_of), "rest": F.regexp_replace(rest, EDGES, ""),
        "named": F.concat(F.regexp_extract("line", MAJOR, 1), F.regexp_extract("line", MAJOR, 2)),
    })
    kept = rows.where((F.col("degree") != "") | (F.col("school") != "") | F.col("range.start").isNotNull())
    kept = kept.withColumn("major", F.when(F.col("named") != "", F.col("named")).when((F.col("school") != "") & F.length("rest").between(2, 24) & ~F.col("rest").rlike("负责|参与|奖"), F.col("rest")).otherwise(""))
    gain = lambda c, by: F.when(c, by).otherwise(0.0)
    score = 0.55 + gain(F.col("school") != "", 0.2) + gain(F.col("degree") != "", 0.1) + gain(F.col("major") != "", 0.1) + gain(F.col("range.start").isNotNull(), 0.05)
    return kept.select("doc_id", "line_no", "school", "degree", "major", F.col("range.start").cast("string").alias("start"), F.col("range.months").alias("months"), F.round(F.least(score, F.lit(0.98)), 2).alias("confidence"))


def award_entries(section_lines: DataFrame) -> DataFrame:
    """H28. Lines of the awards section with their year."""
    year = F.regexp_extract("line", DATE, 0)
    return section_lines.where(F.col("section") == "awards").select("doc_id", "line_no", year.alias("year"), F.when(year != "", 0.8).otherwise(0.6).alias("confidence"))


def experience_blocks(section_lines: DataFrame, header: str) -> DataFrame:
    """H28. Blocks of an experience section: a header line opens one, the lines up to the next are its bullets; lines before the first header are block 0."""
    w = Window.partitionBy("doc_id", "section").orderBy("line_no")
    rows = section_lines.where(F.col("section").isin("internship", "projects", "campus")).withColumn("head", F.lower("line").rlike(header).cast("int"))
    rows = rows.withColumn("block", F.sum("head").over(w))
    return rows.groupBy("doc_id", "section", "block").agg(F.min("line_no").alias("first_line"), F.sum(1 - F.col("head")).alias("bullets"))


def canonical_skills(hits: DataFrame, most: int = 40) -> DataFrame:
    """H29. From hits (doc_id, section, term, root): each root's best source and confidence: .9 where the term is the root, in skills; .72 in experience; .78 elsewhere; `most` a document."""
    skills, exp = F.col("section") == "skills", F.col("section").isin("internship", "projects", "campus")
    rows = hits.select("doc_id", "root", F.when(skills, "skills_section").when(exp, "implicit").otherwise("lexicon").alias("source"), F.when(F.col("term") == F.col("root"), F.when(exp & ~skills, 0.72).otherwise(0.9)).when(exp, 0.72).otherwise(0.78).alias("confidence"))
    best = rows.groupBy("doc_id", "root").agg(F.max(F.struct("confidence", "source")).alias("b")).select("doc_id", "root", "b.source", "b.confidence")
    w = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "root")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def profile_stats(skills: DataFrame, education: DataFrame, awards: DataFrame, months: DataFrame) -> DataFrame:
    """D22. Of each document: skills, implicit ones, education and award entries, months, years and mean confidence of the skills. months: (doc_id, months)."""
    none, kind = F.lit(None), F.col("kind")
    # one grouping and no join, for whose sake keys would be tested before lines are numbered: so lines of the same source move once
    rows = skills.select("doc_id", F.lit("skills").alias("kind"), "source", "confidence")
    for name, entries in (("education", education), ("awards", awards)):
        rows = rows.unionByName(entries.select("doc_id", F.lit(name).alias("kind"), none.cast("string").alias("source"), none.cast("double").alias("confidence")))
    n = lambda name: F.when(F.col("doc_id").isNotNull(), F.count_if(kind == name)).otherwise(0).alias(name)
    found = rows.groupBy("doc_id").agg(F.count_if(kind == "skills").alias("skills"), F.count_if(F.col("source") == "implicit").alias("implicit"), F.round(F.avg("confidence"), 2).alias("confidence"), n("education"), n("awards"))
    joined = found.where("skills > 0").join(months, "doc_id", "left").fillna(0, ["months"])
    return joined.withColumn("years", F.round(F.col("months") / 12, 2))


def analysis_events(scored: DataFrame, hits: DataFrame, missing: DataFrame) -> DataFrame:
    """S1. The ordered event log of each analysis: start, each section that is missing, each hit, the score, done."""
    h = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("hits"))
    rows = scored.select("doc_id", "total").join(h, "doc_id", "left").join(missing, "doc_id", "left")
    none = F.array().cast("array<string>")
    event = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    events = F.concat(
        F.array(event("step", F.lit("start"))), F.transform(F.coalesce("missing", none), lambda x: event("miss", x)), F.transform(F.coalesce("hits", none), lambda x: event("hit", x)),
        F.array(event("score", F.col("total")), event("step", F.lit("done"))),
    )
    return rows.select("doc_id", F.posexplode(events).alias("seq", "e")).select("doc_id", "seq", "e.kind", "e.value")
