"""Web pages: visible text, title, degree and skills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, mask_numbers


def visible_text(html: Column, most: int | None = None) -> Column:
    """H7. Text without scripts, styles and tags; blanks squeezed, personal data masked; all of it, or the first `most` characters."""
    text = F.coalesce(html, F.lit(""))
    for pattern, by in ((r"(?is)<(script|style|noscript|svg|template)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "), (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&amp;", "&"), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, by)
    whole = mask_numbers(F.trim(text))
    return whole if most is None else F.substring(whole, 1, most)


def page_title(html: Column) -> Column:
    """H8. The title, 200 characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), 1, 200)


def infer_degree(c: Column, rules: Sequence[tuple[str, int, str]], above: str) -> Column:
    """H9. minimum: the lowest degree that is named, or the one that an "and above" phrase follows; preferred: the highest named; 0 for none. Ranks.
    c is computed once, whatever it is made of, and a phrase is looked for only where its degree is named."""
    held = lambda low: F.array_compact(F.array(*(F.when(low.rlike(p), F.struct(F.lit(rank).alias("rank"), low.rlike(p + r"\W{0,3}" + above).alias("fixed"))) for _, rank, p in rules)))

    def ranks(found: Column) -> Column:
        named, fixed = F.transform(found, lambda x: x["rank"]), F.transform(F.filter(found, lambda x: x["fixed"]), lambda x: x["rank"])
        return F.struct(F.coalesce(F.array_min(fixed), F.array_min(named), F.lit(0)).alias("minimum"), F.coalesce(F.array_max(named), F.lit(0)).alias("preferred"))

    return let(let(F.lower(c), held), ranks)


def skill_mentions(c: Column, terms: Sequence[str]) -> Column:
    """H10. Terms that the text holds, in the order of the list. c is computed once, not once a term."""
    return let(F.lower(c), lambda low: F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, F.lower(t))))


def pages_to_jobs(pages: DataFrame, rules) -> DataFrame:
    """A6. A job record of each page: title, visible text, degrees, skills; pending review."""
    text = pages.select("page_id", F.col("url").alias("source_url"), page_title(F.col("html")).alias("title"), visible_text(F.col("html")).alias("text_redacted"))
    degree = infer_degree(F.col("text_redacted"), rules.degrees, rules.above)
    return text.select(
        "page_id", "source_url", "title", "text_redacted", degree["minimum"].alias("degree_minimum"), degree["preferred"].alias("degree_preferred"), skill_mentions(F.col("text_redacted"), rules.skills).alias("skill_mentions"),
        F.lit("pending").alias("review_status"),
    )
