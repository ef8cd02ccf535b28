"""Lines of documents: sections, layout, quality, evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import CORE_SECTIONS, EXPERIENCE_SECTIONS, SECTION_ALIASES, RuleSet
from ..functions.text import NAME_LABEL, canon_line, class_of, is_name, line_class, meets, name_hint, norm_line, redact, residual_pii, target_position

METRIC, DATE = r"[0-9]+(\.[0-9]+)? ?(%|\+|k\b)|[0-9]{3,}", r"\b(19|20)[0-9]{2}\b"
#: What every METRIC has, and costs less to look for.
MAYBE_METRIC = r"[0-9](?:[0-9]{2}| ?[%+k])"
CONTACT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.|\([0-9]{3}\) [0-9]{3}-[0-9]{4}"
#: Words for a sought position.
INTENT = r"(?i)(求职意向|意向岗位|目标岗位|应聘岗位|应聘职位|期望岗位|求职方向|目标职位|Desired\s*Position|Objective)"
TABLE = r"\s\|\s|\t"


def by_doc() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_no")


def lines_of(docs: DataFrame) -> DataFrame:
    """Non-blank lines of each document, numbered from 1 as they stand."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.length(F.trim("line")) > 0).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def redaction_report(docs: DataFrame) -> DataFrame:
    """D18. Masked personal data by kind, in all and in how many documents; needs_review: documents that still show some, empty: those without text."""
    masked = docs.select(redact(F.col("text")).alias("r"))
    flags = {"needs_review": F.size(residual_pii(F.col("r.text"))) > 0, "empty": F.trim("r.text") == ""}
    kinds = F.map_concat("r.counts", F.create_map(*(x for name, flag in flags.items() for x in (F.lit(name), flag.cast("int")))))
    return masked.select(F.explode(kinds).alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("documents"))


def merge_label_lines(lines: DataFrame, label: str = r"^[A-Za-z]{1,12}[.:]?$", most: int = 40) -> DataFrame:
    """E14. A line that is only a label takes the value on the next one; a value is no label and has `most` characters at most."""
    rows = lines.withColumn("line", norm_line(F.col("line"))).withColumn("is_label", F.col("line").rlike(label))
    rows = rows.withColumn("is_value", ~F.col("is_label") & (F.length("line") <= most))
    w = by_doc()
    takes = F.col("is_label") & F.coalesce(F.lead("is_value").over(w), F.lit(False))
    taken = F.col("is_value") & F.coalesce(F.lag("is_label").over(w), F.lit(False))
    rows = rows.select("doc_id", "line_no", F.when(takes, F.concat(F.regexp_replace("line", "[.:]+$", ""), F.lit(": "), F.lead("line").over(w))).otherwise(F.col("line")).alias("line"), taken.alias("taken"))
    return rows.where("NOT taken").drop("taken")


def segment_by_heading(lines: DataFrame, headings: Mapping[str, str]) -> DataFrame:
    """E15. A heading, known by its first word, sets the section of its line and those that follow; before the first it is basic_info."""
    word = F.lower(F.regexp_extract(F.trim("line"), r"^[A-Za-z]+", 0))
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in headings.items() for x in pair)), word)
    w = by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("heading", named).withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit("basic_info")))


def name_in_sections(docs: DataFrame, section_lines: DataFrame, sections: Sequence[str] = ("basic_info", "summary")) -> DataFrame:
    """H4. doc_id and name: at a label of the text, else in a line of the sections, in their order (at a label or alone), else as name_hint() finds one; empty without, null text: null."""
    labelled = lambda c: F.regexp_extract(c, NAME_LABEL, 1)
    line = norm_line(F.col("line"))
    rows = section_lines.where(F.col("section").isin(*sections)).select("doc_id", "section", "line_no", F.when(is_name(labelled(line)), labelled(line)).when(is_name(line), line).alias("name")).where("name IS NOT NULL")
    order = F.struct(F.array_position(F.array(*map(F.lit, sections)), F.col("section")), "line_no")
    first = rows.groupBy("doc_id").agg(F.min_by("name", order).alias("in_section"))
    text = F.col("text")
    name = F.when(text.isNotNull(), F.coalesce(F.when(is_name(labelled(text)), labelled(text)), "in_section", name_hint(text)))
    return docs.select("doc_id", "text").join(first, "doc_id", "left").select("doc_id", name.alias("name"))


def dedupe_lines(section_lines: DataFrame) -> DataFrame:
    """E17. The first of equal lines (by canonical form) of each section of a document."""
    keyed = section_lines.withColumn("canon", canon_line(F.col("line"))).where("canon <> ''")
    w = Window.partitionBy("doc_id", "section", "canon").orderBy("line_no")
    return keyed.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def normalise_sections(section_lines: DataFrame, aliases: Mapping[str, str] = SECTION_ALIASES) -> DataFrame:
    """H34. Section names in lower case and under their main names; blank and repeated lines out."""
    low = F.lower("section")
    named = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), low), low)
    rows = section_lines.withColumn("section", named).withColumn("line", F.trim("line")).where("line <> ''")
    w = Window.partitionBy("doc_id", "section", "line").orderBy("line_no")
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def infer_sections(section_lines: DataFrame, rules: RuleSet) -> DataFrame:
    """H35. Sections from what the lines say, document by document: a line's class, with the section so far, gives its section; then lines move.

    In the order of a document's lines: a skills, award or education line opens its section; a duty or role title stays in the experience
    section it stands in and opens internship elsewhere; any other line stays. Then education lines within skills go to education where that is still empty.
    One window, no document gathered: the last line that sets a section by itself counts (its class opens one, or the given section changes
    there), and whether a duty or role title has come since. A null section is that of the line before.
    """
    w = by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = section_lines.withColumn("kind", line_class(F.col("line"), rules.line_classes)).withColumn("changes", F.col("section") != F.coalesce(F.lag("section").over(by_doc()), F.lit("")))
    duty = F.col("kind").isin("duty", "role_title")
    stays = lambda c: F.col(c).isin(*EXPERIENCE_SECTIONS)
    opened = F.when(F.col("kind") == "skills", "skills").when(F.col("kind") == "award", "awards").when(F.col("kind") == "education", "education")
    given = F.when(F.col("changes"), F.when(duty & ~stays("section"), "internship").otherwise(F.col("section")))
    rows = rows.withColumn("sets", F.coalesce(opened, given))
    rows = rows.withColumns({"base": F.coalesce(F.last("sets", ignorenulls=True).over(w), F.lit("basic_info")), "set_at": F.max(F.when(F.col("sets").isNotNull(), F.col("line_no"))).over(w), "duty_at": F.max(F.when(duty, F.col("line_no"))).over(w)})
    since = F.coalesce(F.col("duty_at") > F.coalesce("set_at", F.lit(-1)), F.lit(False))
    rows = rows.withColumn("placed", F.when(since & ~stays("base"), "internship").otherwise(F.col("base")))
    rows = rows.withColumn("has", F.max(F.col("placed") == "education").over(Window.partitionBy("doc_id")))
    to_education = ~F.col("has") & (F.col("placed") == "skills") & F.lower("line").rlike(dict(rules.line_classes).get("education", "$^"))
    return rows.select("doc_id", "line_no", "line", F.when(to_education, "education").otherwise(F.col("placed")).alias("section"), "kind")


def layout(lines: DataFrame, variant: str = "parser") -> DataFrame:
    """H30. Counts of lines by form and the complexity of the layout, for the parser or for pools; and layout tags."""
    size = F.length(F.trim("line"))
    short = size <= 4 if variant == "parser" else (size <= 4) | F.trim("line").rlike(r"^[A-Za-z0-9]{1,2}$")
    rows = lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if(short).alias("short"), F.count_if(F.col("line").rlike(TABLE)).alias("tables"), F.count_if(size > 120).alias("long"), F.sum(size).alias("chars"), F.sum(F.length("line") + 1).alias("all_chars")
    )
    share, mean, density = F.col("short") / F.col("lines"), F.col("chars") / F.col("lines"), F.col("all_chars") / F.col("lines")
    step = lambda c, *steps: next(iter(_steps(c, steps)))
    total = step(F.col("lines"), (40, 1.2), (25, 0.7)) + step(share, (0.35, 1.3), (0.2, 0.6)) + step(F.col("tables"), (6, 1.4), (2, 0.7))
    if variant == "parser":
        total = total + step(F.col("long"), (2, 0.6))
    else:
        total = total + F.when(mean < 12, 0.8).otherwise(0.0) + F.when(density < 18, 0.5).otherwise(0.0) + step(F.col("long"), (3, 0.9))
    tags = F.array_compact(F.array(F.when(F.col("tables") >= 2, "table"), F.when(share >= 0.2, "fragments"), F.when(F.col("long") >= 2, "long_lines"), F.when(F.col("lines") < 8, "few_lines")))
    return rows.select("doc_id", "lines", "short", "tables", "long", "chars", F.round(total, 3).alias("complexity"), tags.alias("tags"))


def _steps(c: Column, steps: Sequence[tuple[float, float]]):
    out = F.lit(0.0)
    for least, gain in reversed(steps):
        out = F.when(c >= least, gain).otherwise(out)
    yield out


def junk_line(line: Column) -> Column:
    """H30. One character at most; no letter or digit; or mostly blanks between single characters."""
    line = F.trim(line)
    compact = F.length(F.regexp_replace(line, r"\s+", ""))
    blanks = F.regexp_count(line, F.lit(" "))
    return (compact <= 1) | ~line.rlike(r"[\p{L}0-9]") | ((F.length(line) >= 6) & (blanks >= F.greatest(F.lit(3), F.floor(compact / 2))))


def features(docs: DataFrame, section_lines: DataFrame) -> DataFrame:
    """Of each document: characters, sections, junk ratio, contact, intent, metrics, layout; documents without lines too."""
    text = F.trim(F.coalesce("text", F.lit("")))
    own = docs.select("doc_id", F.length(text).alias("size"), text.rlike(CONTACT).alias("has_contact"), has_intent(F.col("text")).alias("has_intent"), F.regexp_count(text, F.lit(METRIC)).alias("metrics"))
    by_line = section_lines.groupBy("doc_id").agg(F.collect_set("section").alias("sections"), F.round(F.count_if(junk_line(F.col("line"))) / F.count("*"), 3).alias("junk"))
    shape = layout(section_lines.select("doc_id", "line_no", "line"), "pool").select("doc_id", "lines", "complexity")
    joined = own.join(by_line, "doc_id", "left").join(shape, "doc_id", "left")
    core = F.size(F.array_intersect("sections", F.array(*map(F.lit, CORE_SECTIONS))))
    filled = joined.withColumns({"sections": F.coalesce("sections", F.array().cast("array<string>")), "junk": F.coalesce("junk", F.lit(1.0)), "lines": F.coalesce("lines", F.lit(0)), "complexity": F.coalesce("complexity", F.lit(0.0))})
    return filled.withColumn("core", core)


def parse_quality(found: DataFrame) -> DataFrame:
    """H32. low, medium or high, and warning codes."""
    has = lambda *s: F.exists("sections", lambda x: x.isin(*s))
    codes = F.array_compact(F.array(
        F.when(F.col("size") == 0, "no_text").when(F.col("size") < 120, "short_text"), F.when(F.col("core") <= 1, "core_missing").when(F.col("core") <= 2, "core_partial"), F.when(F.col("junk") >= 0.4, "noise"),
        F.when(~F.col("has_contact") & (F.col("size") >= 120), "no_contact"),
    ))
    rows = found.withColumn("warnings", codes)
    low = (F.col("size") < 80) | (F.col("core") <= 1) | (F.col("junk") >= 0.55)
    soft = F.size(F.array_except("warnings", F.array(F.lit("no_contact"), F.lit("noise")))) == 0
    strong = (F.col("size") >= 280) & (F.col("core") >= 3) & has("education") & has(*EXPERIENCE_SECTIONS) & has("skills", "projects") & (F.col("junk") < 0.25)
    medium = (F.col("size") < 300) | (F.col("core") <= 2) | (F.size("warnings") > 0)
    return rows.withColumn("quality", F.when(low, "low").when(strong & soft, "high").when(medium, "medium").otherwise("high"))


def has_intent(text: Column) -> Column:
    """H31. Whether a text names a position that is sought: by one of the words for it, or by a label of H33. Null: false."""
    return F.coalesce(text.rlike(INTENT) | (target_position(text) != ""), F.lit(False))


def content_quality(found: DataFrame) -> DataFrame:
    """H31. Content quality and the two pool scores; a sought position (has_intent of `features`) adds 0.6 and 0.3."""
    rich = F.size(F.array_intersect("sections", F.array(*map(F.lit, ("education", "internship", "projects", "skills", "campus", "awards")))))
    size = F.col("size")
    wants = F.coalesce("has_intent", F.lit(False))
    quality = (
        0.9 * F.least(rich, F.lit(5)) + 0.35 * F.least("metrics", F.lit(8)) + F.when(wants, 0.6).otherwise(0.0) + F.when(size >= 400, 0.5).otherwise(0.0) + F.when(size >= 800, 0.4).otherwise(0.0) - F.when(size < 120, 2.0).otherwise(0.0)
    )
    rows = found.withColumn("rich", rich).withColumn("content_quality", F.round(quality, 3))
    a = F.col("content_quality") - 0.85 * F.col("complexity") + F.when(wants, 0.3).otherwise(0.0)
    b = F.col("complexity") + F.when(size < 80, 1.2).otherwise(0.0) + F.when(size < 120, 1.0).otherwise(0.0)
    return rows.withColumn("a_score", F.round(a, 3)).withColumn("b_score", F.round(b, 3))


def assign_pools(scored: DataFrame, a: int, b: int) -> DataFrame:
    """E5. The b most complex documents are B; of the rest the a best are A; the others C. Top rows by limit, not by a window over all."""
    best_b = scored.orderBy(F.desc("b_score"), F.desc("complexity"), "size", "doc_id").limit(b).select("doc_id", F.lit("B").alias("pool_b"))
    rest = scored.join(best_b, "doc_id", "left_anti")
    best_a = rest.orderBy(F.desc("a_score"), F.desc("rich"), F.desc("metrics"), F.desc("size"), "doc_id").limit(a).select("doc_id", F.lit("A").alias("pool_a"))
    joined = scored.join(best_b, "doc_id", "left").join(best_a, "doc_id", "left")
    return joined.withColumn("pool", F.coalesce("pool_b", "pool_a", F.lit("C"))).drop("pool_a", "pool_b")


#: H17. Lines that are no experience whatever their section, and how many lines of each sort are named.
NO_EXPERIENCE = ("education", "skills", "award")
NAMED = {"weak": 5, "vague": 5, "long": 5, "title": 3, "metric": 3, "action": 3, "course": 5, "domain": 6}
MOST_ZONES, MOST_DOMAINS = 6, 12


def evidence(section_lines: DataFrame, rules: RuleSet) -> DataFrame:
    """H17. Evidence of each document: counts over its experience lines, the first lines of each sort by number, domain words, missing core sections, low-signal zones and confidence.

    Experience lines are those of experience sections that have six characters at least, stand there for the first time and are no education, skills or award. Of them are weak: duties
    of 12 to 110 characters without metric and result; role titles: 12 to 120 characters. All lines are looked at for length (over 90), vague words (but
    for education, skills and award), courses and domain words. `weak`, `vague`, `long` and `role_titles` are the numbers of lines that are named.
    Zones (reason:line, six at most): weak, then title, then vague lines, a text once; without any the first short duty (under 40 characters, no metric). duty_zones counts the weak ones.
    One window by document numbers the lines of each sort as they come, so that no more are gathered than are named.
    """
    low = F.col("low")
    size = F.length(F.trim("line"))
    pattern = lambda p: meets(low, p or "$^")
    rows = section_lines.select("doc_id", "line_no", "line", "section", F.lower("line").alias("low"))
    rows = rows.select("doc_id", "line_no", "section", "low", F.trim("line").alias("own"), size.alias("size"), class_of(low, rules.line_classes).alias("kind"))
    may = F.col("section").isin(*EXPERIENCE_SECTIONS) & (F.col("size") >= 6) & ~F.col("kind").isin(*NO_EXPERIENCE)
    # metrics, actions and results count in experience lines only
    rows = rows.withColumn("may", may).select(
        "doc_id", "line_no", "section", "own", "size", "kind", "may", (F.col("may") & low.rlike(MAYBE_METRIC) & low.rlike(METRIC)).alias("has_metric"), (F.col("may") & pattern(rules.actions)).alias("has_action"),
        (F.col("may") & pattern(rules.results)).alias("has_result"), pattern(rules.vague).alias("has_vague"), ((F.contains(low, F.lit("19")) | F.contains(low, F.lit("20"))) & low.rlike(DATE)).alias("date"), pattern(rules.courses).alias("course"),
        F.array_compact(F.array(*(F.when(F.contains(low, F.lit(d.lower())), F.lit(d)) for d in rules.domains))).alias("domains"),
    )
    rows = rows.withColumn("exp", F.col("may") & (F.row_number().over(Window.partitionBy("doc_id", "own", "may").orderBy("line_no")) == 1))
    duty = F.col("exp") & (F.col("kind") == "duty")
    rows = rows.withColumns({
        "weak": duty & F.col("size").between(12, 110) & ~F.col("has_metric") & ~F.col("has_result"), "title": F.col("exp") & (F.col("kind") == "role_title") & F.col("size").between(12, 120), "long": F.col("size") > 90,
        "vague": F.col("has_vague") & ~F.col("kind").isin(*NO_EXPERIENCE), "metric": F.col("exp") & F.col("has_metric"), "action": F.col("exp") & F.col("has_action"), "domain": F.size("domains") > 0,
        "short": duty & (F.col("size") < 40) & ~F.col("has_metric"),
    })
    w = by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"is_{c}": F.col(c) & (F.sum(F.col(c).cast("int")).over(w) <= k) for c, k in NAMED.items()})
    rows = rows.withColumn("zone", F.when(F.col("is_weak"), 0).when(F.col("is_title"), 1).when(F.col("is_vague"), 2))
    rows = rows.withColumn("once", F.col("zone").isNotNull() & (F.row_number().over(Window.partitionBy("doc_id", "own", F.col("zone").isNotNull()).orderBy("zone", "line_no")) == 1))
    named = lambda c: F.array_sort(F.collect_list(F.when(F.col(f"is_{c}"), F.col("line_no")))).alias(f"{c}_lines")
    n = lambda c: F.count_if(F.col(c))
    zones = F.slice(F.array_sort(F.collect_list(F.when(F.col("once"), F.struct("zone", "line_no")))), 1, MOST_ZONES)
    found = rows.groupBy("doc_id").agg(
        n("exp").alias("exp_lines"), n("metric").alias("metrics"), n("action").alias("actions"), F.count_if(F.col("exp") & F.col("has_result")).alias("results"), n("date").alias("dates"), *(n(f"is_{c}").alias(c) for c in ("vague", "long", "weak")),
        n("is_title").alias("role_titles"), *map(named, NAMED), F.array_sort(F.array_distinct(F.flatten(F.collect_set("domains")))).alias("words"), F.collect_set("section").alias("there"), zones.alias("zoned"),
        F.min(F.when(F.col("short"), F.col("line_no"))).alias("short_line"),
    )
    reasons = F.array(*map(F.lit, ("weak", "title", "vague")))
    zoned = F.transform("zoned", lambda z: F.concat_ws(":", F.element_at(reasons, z["zone"] + 1), z["line_no"].cast("string")))
    fallback = F.when(F.col("short_line").isNotNull(), F.array(F.concat(F.lit("short:"), F.col("short_line").cast("string")))).otherwise(F.array().cast("array<string>"))
    given = F.array(*map(F.lit, rules.domains)) if rules.domains else F.array().cast("array<string>")
    found = found.withColumns({
        "zones": F.when(F.size("zoned") > 0, zoned).otherwise(fallback), "domain_words": F.slice(F.filter(given, lambda d: F.array_contains("words", d)), 1, MOST_DOMAINS),
        "missing": F.array_except(F.array(*map(F.lit, CORE_SECTIONS)), F.col("there")),
    }).drop("zoned", "words", "there", "short_line")
    found = found.withColumn("duty_zones", F.size(F.filter("zones", lambda z: F.startswith(z, F.lit("weak")))).cast("bigint"))
    least = lambda c, k: F.least(F.col(c), F.lit(k))
    raw = 0.55 + 0.12 * least("metrics", 4) + 0.08 * least("results", 3) - 0.07 * least("weak", 4) - 0.05 * least("vague", 3)
    return found.withColumn("confidence", F.when(F.col("exp_lines") == 0, 0.4).otherwise(F.round(F.least(F.greatest(raw, F.lit(0.2)), F.lit(0.95)), 2)))


def section_blocks(section_lines: DataFrame, quality: DataFrame) -> DataFrame:
    """H36. Lines, confidence and its label for each section of a document; structured: the section has a line with a date."""
    rows = section_lines.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.bool_or(F.col("line").rlike(DATE)).alias("structured")).join(quality.select("doc_id", "quality"), "doc_id")
    base = F.when(F.col("quality") == "high", 0.9).when(F.col("quality") == "medium", 0.72).otherwise(0.45)
    bonus = F.least(F.lit(0.08), 0.02 * F.col("lines")) + F.when(F.col("section").isin("internship", "projects", "education", "skills"), 0.05).otherwise(0.0) + F.when(F.col("structured"), 0.04).otherwise(0.0)
    confidence = F.when(F.col("quality") == "low", F.least(base, F.lit(0.5))).otherwise(F.least(base + bonus, F.lit(0.98)))
    rows = rows.withColumn("confidence", F.round(confidence, 2))
    return rows.withColumn("label", F.when(F.col("confidence") >= 0.85, "complete").when(F.col("confidence") >= 0.65, "basic").otherwise("weak"))


def missing_sections(found: DataFrame) -> DataFrame:
    """H36. Core sections that a document lacks."""
    return found.select("doc_id", F.array_except(F.array(*map(F.lit, CORE_SECTIONS)), F.col("sections")).alias("missing"))


def excerpt(lines: DataFrame, priority: str, limit: int = 400) -> DataFrame:
    """H40. Of each document its text where that is short, else its lines with priority words first, cut to `limit` characters."""
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "line_no", F.trim("line").alias("t")))), lambda x: x["t"]), "\n")
    order = F.when(F.lower("line").rlike(priority), 0).otherwise(1).alias("p")
    rows = lines.groupBy("doc_id").agg(text(F.lit(0).alias("p")).alias("whole"), text(order).alias("sorted"))
    return rows.select("doc_id", F.when(F.length("whole") <= limit, F.col("whole")).otherwise(F.substring("sorted", 1, limit)).alias("excerpt"))


def boundary_cards(found: DataFrame) -> DataFrame:
    """H39. The warning that matters most by a fixed order, and what to do about the document."""
    order = ("no_text", "core_missing", "noise", "short_text", "core_partial", "no_contact")
    pick = F.coalesce(*(F.when(F.array_contains("warnings", w), F.lit(w)) for w in order), F.lit(""))
    act = F.when(F.col("quality") == "low", "reject_or_rescan").when(F.col("complexity") >= 3.5, "review_layout").when(F.col("quality") == "medium", "check").otherwise("accept")
    return found.select("doc_id", "quality", pick.alias("core_warning"), act.alias("behaviour"))


def boundary_summary(cards: DataFrame) -> DataFrame:
    """D23. Cards by quality, and how many are low."""
    return cards.groupBy("quality").agg(F.count("*").alias("n")).withColumn("low", F.when(F.col("quality") == "low", F.col("n")).otherwise(0))
