"""Queries over documents, their lines and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from ..functions.han import HAN
from ..functions.rules import LATIN
from ..operators import lines as L
from ..operators import sections as P
from ..operators import terms as M
from .views import Views, duck

PRIORITY = r"\b(ering|tion|the)\b"
PHRASES = ("idiot", "token", "ering the", "de la")
SPAN_TERMS = ("onre", "the", "thea", "tion")


def segmented(v: Views):
    return L.segment_by_heading(v.v_line, LATIN.headings)


def found(v: Views):
    return L.features(v.documents.select("doc_id", wanted()), segmented(v))


def wanted():
    """A third of the texts name a sought position, which the tables do not."""
    return F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("求职意向 "), F.coalesce("text", F.lit("")))).when(F.col("doc_id") % 6 == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("\nTarget: data analyst"))).otherwise(F.col("text")).alias("text")


def job_terms(v: Views):
    return v.v_job.select(F.explode(F.concat("must", F.array(F.lit("c3"), F.lit("3d"), F.lit("with")))).alias("term")).distinct()



LEAST_COSINE = 0.3


def cosines(v: Views, least: float = 0.0):
    tokens, more = (T.vector_tokens(F.col("text"), LATIN.aliases) for _ in range(2)), (T.absent_roots(F.col("text"), LATIN.aliases) for _ in range(2))
    return M.tfidf_cosine(v.documents, v.benchmark, M.fit_idf(v.documents), *tokens, "doc_id", "item_id", *more, least=least).select("doc_id", "item_id", "cosine", "confidence")


def phrases_of(text):
    """Two words that follow each other."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))


QUERIES = {
    "h1_norm_line": lambda v: v.v_line.select("doc_id", "line_no", T.norm_line(F.col("line")).alias("norm"), T.canon_line(F.col("line")).alias("canon")),
    "h2_job_tokens": lambda v: v.documents.select("doc_id", T.job_tokens(F.col("text")).alias("tokens")),
    "h2_vector_tokens": lambda v: v.documents.select("doc_id", T.vector_tokens(F.col("text"), LATIN.aliases).alias("tokens")),
    "h3_contains_kw": lambda v: v.documents.select("doc_id", *(T.contains_kw(F.lower("text"), k).alias(n) for n, k in (("the", "the"), ("c3", "c3"), ("onre", "onre")))),
    "h4_contacts": lambda v: v.v_resume.select("doc_id", T.contacts(F.col("text")).alias("c"), T.name_hint(F.col("text")).alias("name")).select("doc_id", "c.*", "name"),
    "h5_redact": lambda v: v.v_resume.select("doc_id", T.redact(F.col("text")).alias("r")).select("doc_id", "r.text", *(F.element_at("r.counts", k).alias(k) for k in T.KINDS)),
    "h6_residual_pii": lambda v: v.documents.select("doc_id", T.residual_pii(F.col("text")).alias("kinds")),
    "d18_redaction_report": lambda v: L.redaction_report(v.v_resume),
    "h7_visible_text": lambda v: v.pages.select("page_id", W.visible_text(F.col("html")).alias("text")),
    "h8_page_title": lambda v: v.pages.select("page_id", W.page_title(F.col("html")).alias("title")),
    "h9_infer_degree": lambda v: v.pages.select("page_id", W.infer_degree(W.visible_text(F.col("html")), LATIN.degrees, LATIN.above).alias("d")).select("page_id", "d.*"),
    "h10_skill_mentions": lambda v: v.pages.select("page_id", W.skill_mentions(W.visible_text(F.col("html")), LATIN.skills).alias("skills")),
    "a6_pages_to_jobs": lambda v: W.pages_to_jobs(v.pages, LATIN).select("page_id", "title", "degree_minimum", "degree_preferred", "skill_mentions", "review_status"),
    "h16_line_class": lambda v: v.v_line.select("doc_id", "line_no", T.line_class(F.col("line"), LATIN.line_classes).alias("kind")),
    "h17_evidence": lambda v: L.evidence(segmented(v), LATIN),
    "h30_layout_parser": lambda v: L.layout(v.v_line).select("doc_id", "lines", "short", "tables", "long", "complexity", "tags"),
    "h30_layout_pool": lambda v: L.layout(v.v_line, "pool").select("doc_id", "complexity"),
    "h30_junk_ratio": lambda v: v.v_line.groupBy("doc_id").agg((F.count_if(L.junk_line(F.col("line"))) / F.count("*")).alias("junk")),
    "h31_content_quality": lambda v: L.content_quality(found(v)).select("doc_id", "has_intent", "rich", "metrics", "content_quality", "a_score", "b_score"),
    "h32_parse_quality": lambda v: L.parse_quality(found(v)).select("doc_id", "quality", "warnings"),
    "h33_target_from_name": lambda v: v.v_file.select("file_id", T.target_from_name(F.col("name")).alias("target")),
    "h34_normalise_sections": lambda v: L.normalise_sections(segmented(v).withColumn("section", F.when(F.col("section") == "projects", "Project").otherwise(F.col("section")))).select("doc_id", "line_no", "section", "line"),
    "h35_infer_sections": lambda v: L.infer_sections(segmented(v), LATIN).select("doc_id", "line_no", "section", "kind"),
    "h36_section_blocks": lambda v: L.section_blocks(segmented(v), L.parse_quality(found(v))).select("doc_id", "section", "lines", "confidence", "label"),
    "h36_missing_sections": lambda v: L.missing_sections(found(v)),
    "h37_json_or": lambda v: v.events.select("event_id", T.json_or(F.col("props"), "map<string,string>", F.create_map().cast("map<string,string>")).alias("m")).select("event_id", F.array_sort(F.map_keys("m")).alias("keys")),
    "h38_grade": lambda v: v.v_record.select("record_id", T.grade(F.col("total_score")).alias("grade"), T.label(F.col("status"), {"success": "done", "failed": "error"}).alias("label")),
    "h39_boundary_card": lambda v: L.boundary_cards(L.parse_quality(found(v))),
    "d23_boundary_summary": lambda v: L.boundary_summary(L.boundary_cards(L.parse_quality(found(v)))),
    "h4_name_in_sections": lambda v: L.name_in_sections(v.v_resume, L.segment_by_heading(L.lines_of(v.v_resume), LATIN.headings)),
    "h40_excerpt": lambda v: L.excerpt(v.v_line, PRIORITY),
    "e5_assign_pools": lambda v: L.assign_pools(L.content_quality(found(v)), 50, 30).select("doc_id", "pool"),
    "e12_hit_spans": lambda v: M.hit_spans(v.documents, SPAN_TERMS),
    "e14_merge_label_lines": lambda v: L.merge_label_lines(v.v_line),
    "e15_segment_by_heading": lambda v: segmented(v).select("doc_id", "line_no", "section"),
    "e17_dedupe_lines": lambda v: L.dedupe_lines(segmented(v)).select("doc_id", "line_no", "section", "canon"),
    "e18_top_keywords": lambda v: M.top_keywords(v.documents, PHRASES, LATIN.stop_words),
    "c8_match_terms": lambda v: M.match_terms(v.documents, job_terms(v), LATIN.aliases),
    "c9_hit_sections": lambda v: M.hit_sections(segmented(v), job_terms(v)),
    "d21_fit_idf": lambda v: M.fit_idf(v.documents),
    "h20_tfidf_cosine": lambda v: cosines(v),
    "h20_cosine_join": lambda v: cosines(v, LEAST_COSINE),
    "c8_match_phrases": lambda v: M.match_terms(v.documents, v.benchmark.select(F.explode(phrases_of(F.col("text"))).alias("term"))),
    "h35_place_lines": lambda v: P.place_lines(L.lines_of(v.v_resume), HAN).select("doc_id", "line_no", "section", "line"),
    "h21_vector_cosine": lambda v: v.embeddings.alias("a").join(v.embeddings.alias("b"), F.expr("a.label = b.label AND b.vec_id = a.vec_id + 10")).select(F.col("a.vec_id").alias("vec_id"), M.vector_cosine(F.col("a.embedding"), F.col("b.embedding")).alias("cosine")).withColumn("fused", M.fuse(F.lit(40.0), F.col("cosine") * 100, 0.65)),
}

_HEAD = "VALUES " + ", ".join(f"('{k}', '{s}')" for k, s in LATIN.headings.items())
_SEG = """
SELECT doc_id, line_no, line, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'basic_info') AS section
FROM v_line LEFT JOIN (SELECT * FROM (VALUES_HERE) h(word, section)) h ON h.word = lower(regexp_extract(trim(line), '^[A-Za-z]+'))""".replace("VALUES_HERE", _HEAD)
_REPL = "trim(regexp_replace(line, '[\\s\\x{0085}\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}]+', ' ', 'g'))"
_NORM = f"SELECT doc_id, line_no, {_REPL} AS norm, regexp_replace(lower({_REPL}), '^[ .,;:!?-]+|[ .,;:!?-]+$', '', 'g') AS canon FROM v_line"


def _redact() -> str:
    """One step a kind. RE2 looks at no neighbours: a number between others is masked in a second turn, and names are whole runs of Han characters."""
    known = {k: (p, m) for k, p, m in T.PII} | {k: (p, m.replace("$1", "\\1")) for k, p, m, _ in T.MARKED}
    replaced = lambda c, p, m: f"regexp_replace({c}, '{p}', '{m}', 'g')"
    found = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
    out, last = ["r AS (SELECT doc_id, text FROM v_resume)"], "r"
    for kind in T.KINDS[:-1]:
        if kind == "mobile":
            p, m = f"(^|[^0-9]){T.MOBILE}([^0-9]|$)", "\\1[PHONE]\\2"
            once = replaced("text", p, m)
            text, count = replaced(once, p, m), f"{found('text', p)} + {found(once, p)}"
        elif kind == "school":
            p, m = known[kind]
            text = replaced(replaced(replaced("text", p, "\ufdd0\\1\ufdd1"), "\ufdd0([^\ufdd1]*大学生[^\ufdd1]*)\ufdd1", "\\1"), "\ufdd0[^\ufdd1]*\ufdd1", m)
            count = f"len(list_filter(regexp_extract_all(text, '{p}'), lambda x: NOT contains(x, '大学生')))"
        else:
            p, m = known[kind]
            text, count = replaced("text", p, m), found("text", p)
        out.append(f"r_{kind} AS (SELECT * REPLACE ({text} AS text), {count} AS {kind} FROM {last})")
        last = f"r_{kind}"
    first = "regexp_extract(text, '^\\s*([^\\s|/／]+)', 1)"
    out.append(f"r_names AS (SELECT *, list_distinct(list_filter(list_append(regexp_extract_all(text, '{T.NAME_LABEL}', 1), {first.replace('text', 'string_split(text, chr(10))[1]')}), lambda x: {_is_name('x')})) AS names FROM {last})")
    runs = f"regexp_extract_all(text, '[{T.HAN}·]+')"
    swap = lambda c: f"regexp_replace({c}, '(^|[^{T.HAN}·])(' || array_to_string(names, '|') || ')($|[^{T.HAN}·])', '\\1[NAME]\\3', 'g')"
    out.append(f"r_name AS (SELECT * REPLACE (CASE WHEN len(names) > 0 THEN {swap(swap('text'))} ELSE text END AS text), len(list_filter({runs}, lambda x: list_contains(names, x))) AS name FROM r_names)")
    return "WITH " + ", ".join(out)


def _is_name(c: str) -> str:
    return f"(regexp_matches({c}, '{T.NAME}') AND {c} NOT IN ({', '.join(map(repr, T.NOT_NAMES))}) AND NOT (regexp_matches({c}, '{T.MAJOR_HINT}') AND length({c}) >= 3) AND NOT regexp_matches({c}, '{T.NOT_A_NAME}'))"


def _u(pattern: str) -> str:
    """A pattern whose word boundaries know all letters, for RE2; it is only asked whether it matches."""
    return pattern.replace("\\b(", r"(^|[^\p{L}\p{N}_])(").replace(")\\b", r")($|[^\p{L}\p{N}_])").replace("\\b", r"($|[^\p{L}\p{N}_])")


_KINDS = ", ".join(T.KINDS)
_SQUEEZED = "regexp_replace(regexp_replace(text, '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
_LABEL = f"regexp_extract(text, '{T.NAME_LABEL}', 1)"
_CELLS = "flatten(list_transform(string_split(text, chr(10))[1:12], lambda x: list_transform(string_split(x, '|'), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g')))))"
_CLASS = lambda c: "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{_u(p)}') THEN '{k}'" for k, p in LATIN.line_classes) + " ELSE 'other' END"
_VISIBLE = "coalesce(html, '')"
for _p, _by in ((r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<svg\b.*?</svg\s*>|<template\b.*?</template\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), (r"\s+", " ")):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '{_p}', '{_by}', 'g')"
_VISIBLE = f"trim({_VISIBLE})"
for _k, _p, _by in T.PII:
    _VISIBLE = f"regexp_replace({_VISIBLE}, '{_p}', '{_by}', 'g')"
_VISIBLE = f"regexp_replace(regexp_replace({_VISIBLE}, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
_PAGE = f"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))[1:200] AS title, {_VISIBLE} AS text FROM pages"
_NAMED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{_u(p)}') THEN {r} END" for _, r, p in LATIN.degrees) + "], lambda x: x IS NOT NULL)"
_FIXED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}\\W{{0,3}}{LATIN.above}') THEN {r} END" for _, r, p in LATIN.degrees) + "], lambda x: x IS NOT NULL)"
_degree = lambda lo, hi: f"coalesce(list_min({_FIXED}), list_min({_NAMED}), 0) AS {lo}, coalesce(list_max({_NAMED}), 0) AS {hi}"
_SKILLS = "list_filter([" + ", ".join(f"'{s}'" for s in LATIN.skills) + "], lambda t: contains(lower(text), t))"
_JUNK = r"(length(regexp_replace(trim(line), '\s+', '', 'g')) <= 1 OR NOT regexp_matches(trim(line), '[\p{L}0-9]') OR (length(trim(line)) >= 6 AND len(regexp_extract_all(trim(line), ' ')) >= greatest(3, length(regexp_replace(trim(line), '\s+', '', 'g')) // 2)))"
_LAY = f"""
SELECT doc_id, count(*) AS lines, count(*) FILTER (length(trim(line)) <= 4) AS short, count(*) FILTER (regexp_matches(line, '{L.TABLE}')) AS tables, count(*) FILTER (length(trim(line)) > 120) AS long,
  sum(length(trim(line))) AS chars, sum(length(line) + 1) AS all_chars, count(*) FILTER (length(trim(line)) <= 4 OR regexp_matches(trim(line), '^[A-Za-z0-9]{{1,2}}$')) AS short2, count(*) FILTER ({_JUNK}) AS junk FROM v_line GROUP BY 1"""
_STEP = "CASE WHEN lines >= 40 THEN 1.2 WHEN lines >= 25 THEN 0.7 ELSE 0 END + CASE WHEN {0} / lines >= 0.35 THEN 1.3 WHEN {0} / lines >= 0.2 THEN 0.6 ELSE 0 END + CASE WHEN tables >= 6 THEN 1.4 WHEN tables >= 2 THEN 0.7 ELSE 0 END"
_POOL = f"SELECT doc_id, lines, junk, CAST({_STEP.format('short2')} + CASE WHEN chars / lines < 12 THEN 0.8 ELSE 0 END + CASE WHEN all_chars / lines < 18 THEN 0.5 ELSE 0 END + CASE WHEN long >= 3 THEN 0.9 ELSE 0 END AS DOUBLE) AS complexity FROM lay"
_FOUND = f"""
SELECT d.doc_id, coalesce(regexp_matches(text, '{L.INTENT}') OR regexp_matches(text, '(?im)^(?:target|position|objective)\\s*[:=]\\s*.*[^-_/|,\\s0-9]'), false) AS has_intent, length(trim(coalesce(text, ''))) AS size, regexp_matches(trim(coalesce(text, '')), '{L.CONTACT}') AS has_contact, len(regexp_extract_all(trim(coalesce(text, '')), '{L.METRIC}')) AS metrics,
  coalesce(sections, []) AS sections, coalesce(round(junk / lines, 3), 1.0) AS junk, coalesce(complexity, 0.0) AS complexity,
  len(list_intersect(coalesce(sections, []), ['basic_info', 'education', 'internship', 'projects', 'skills'])) AS core,
  len(list_intersect(coalesce(sections, []), ['education', 'internship', 'projects', 'skills', 'campus', 'awards'])) AS rich
FROM wanted d LEFT JOIN (SELECT doc_id, list(DISTINCT section) AS sections FROM seg GROUP BY 1) s USING (doc_id) LEFT JOIN pool p USING (doc_id)"""
_WANTED = "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '求职意向 ' || coalesce(text, '') WHEN doc_id % 6 = 3 THEN coalesce(text, '') || chr(10) || 'Target: data analyst' ELSE text END AS text FROM documents"
_QUALITY = """
SELECT *, CASE WHEN size < 80 OR core <= 1 OR junk >= 0.55 THEN 'low'
  WHEN size >= 280 AND core >= 3 AND list_contains(sections, 'education') AND list_has_any(sections, ['internship', 'projects', 'campus']) AND list_has_any(sections, ['skills', 'projects']) AND junk < 0.25
    AND len(list_filter(warnings, lambda w: w NOT IN ('no_contact', 'noise'))) = 0 THEN 'high'
  WHEN size < 300 OR core <= 2 OR len(warnings) > 0 THEN 'medium' ELSE 'high' END AS quality
FROM (SELECT *, list_filter([CASE WHEN size = 0 THEN 'no_text' WHEN size < 120 THEN 'short_text' END, CASE WHEN core <= 1 THEN 'core_missing' WHEN core <= 2 THEN 'core_partial' END, CASE WHEN junk >= 0.4 THEN 'noise' END,
  CASE WHEN NOT has_contact AND size >= 120 THEN 'no_contact' END], lambda w: w IS NOT NULL) AS warnings FROM found)"""
_CONTENT = """
SELECT *, round(content_quality - 0.85 * complexity + CASE WHEN has_intent THEN 0.3 ELSE 0 END, 3) AS a_score, round(complexity + CASE WHEN size < 80 THEN 1.2 ELSE 0 END + CASE WHEN size < 120 THEN 1.0 ELSE 0 END, 3) AS b_score
FROM (SELECT *, round(0.9 * least(rich, 5) + 0.35 * least(metrics, 8) + CASE WHEN has_intent THEN 0.6 ELSE 0 END + CASE WHEN size >= 400 THEN 0.5 ELSE 0 END + CASE WHEN size >= 800 THEN 0.4 ELSE 0 END - CASE WHEN size < 120 THEN 2.0 ELSE 0 END, 3) AS content_quality FROM found)"""
_CARD = """
SELECT doc_id, quality, coalesce(CASE WHEN list_contains(warnings, 'no_text') THEN 'no_text' END, CASE WHEN list_contains(warnings, 'core_missing') THEN 'core_missing' END, CASE WHEN list_contains(warnings, 'noise') THEN 'noise' END,
  CASE WHEN list_contains(warnings, 'short_text') THEN 'short_text' END, CASE WHEN list_contains(warnings, 'core_partial') THEN 'core_partial' END, CASE WHEN list_contains(warnings, 'no_contact') THEN 'no_contact' END, '') AS core_warning,
  CASE WHEN quality = 'low' THEN 'reject_or_rescan' WHEN complexity >= 3.5 THEN 'review_layout' WHEN quality = 'medium' THEN 'check' ELSE 'accept' END AS behaviour FROM judged"""
_WORD = "regexp_extract_all(lower(text), '[a-z][a-z0-9+#.]*')"
_TOKENS = f"flatten(list_transform(w, lambda t: list_filter([t, CASE t {' '.join(f'WHEN {a!r} THEN {r!r}' for a, r in LATIN.aliases.items())} END], lambda x: x IS NOT NULL)))"
_ROOTS = "list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{a}') AND NOT contains(lower(text), '{r}') THEN '{r}' END" for a, r in LATIN.aliases.items()) + "], lambda x: x IS NOT NULL))"
_IDF = f"SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM (SELECT DISTINCT doc_id, unnest({_WORD}) AS term FROM documents) GROUP BY 1"
_TERM = "SELECT DISTINCT unnest(list_concat(must, ['c3', '3d', 'with'])) AS term FROM v_job"
_PAIRS = ", ".join(f"('{a}', '{r}')" for a, r in LATIN.aliases.items())
_NAME = f"""
SELECT term, term AS name FROM term UNION SELECT term, coalesce(root, term) FROM term LEFT JOIN (VALUES {_PAIRS}) p(alias, root) ON alias = term
UNION SELECT t.term, q.alias FROM term t LEFT JOIN (VALUES {_PAIRS}) p(alias, root) ON p.alias = t.term JOIN (VALUES {_PAIRS}) q(alias, root) ON q.root = coalesce(p.root, t.term)"""
_RUN = "SELECT DISTINCT {0}, rtrim(unnest(regexp_extract_all(lower({1}), '[a-z0-9+#.]+')), '.') AS name FROM {2}"


_DOMAINS = "[" + ", ".join(f"'{d}'" for d in LATIN.domains) + "]"
_NAMES = lambda flag, k: f"coalesce(list(line_no ORDER BY line_no) FILTER ({flag}), [])[1:{k}]"
_EVIDENCE = f"""
WITH l AS (
  SELECT doc_id, line_no, line, section, trim(line) AS own, length(trim(line)) AS size, {_CLASS('line')} AS kind, regexp_matches(lower(line), '{L.METRIC}') AS m, regexp_matches(lower(line), '{_u(LATIN.actions)}') AS a, regexp_matches(lower(line), '{_u(LATIN.results)}') AS r,
    regexp_matches(lower(line), '{_u(LATIN.vague)}') AS v, regexp_matches(lower(line), '{L.DATE}') AS dt, regexp_matches(lower(line), '{_u(LATIN.courses)}') AS course, list_filter({_DOMAINS}, lambda d: contains(lower(line), d)) AS ds FROM seg),
x AS (SELECT *, section IN ('internship', 'projects', 'campus') AND size >= 6 AND kind NOT IN ('education', 'skills', 'award') AS may FROM l),
y AS (SELECT *, may AND line_no = min(line_no) OVER (PARTITION BY doc_id, own, may) AS e FROM x),
z AS (SELECT *, e AND kind = 'duty' AND size BETWEEN 12 AND 110 AND NOT m AND NOT r AS weak, e AND kind = 'role_title' AND size BETWEEN 12 AND 120 AS title, v AND kind NOT IN ('education', 'skills', 'award') AS vague FROM y),
k AS (SELECT doc_id, {_NAMES('weak', 5)} AS weak_lines, {_NAMES('title', 3)} AS title_lines, {_NAMES('vague', 5)} AS vague_lines FROM z GROUP BY 1),
place AS (
  SELECT z.doc_id, own, line_no, CASE WHEN list_contains(weak_lines, line_no) THEN 0 WHEN list_contains(title_lines, line_no) THEN 1 WHEN list_contains(vague_lines, line_no) THEN 2 END AS reason FROM z JOIN k USING (doc_id)),
zone AS (SELECT doc_id, list(['weak', 'title', 'vague'][reason + 1] || ':' || line_no ORDER BY reason, line_no)[1:6] AS zones FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, own ORDER BY reason, line_no) AS n FROM place WHERE reason IS NOT NULL) WHERE n = 1 GROUP BY 1),
g AS (
  SELECT doc_id, count(*) FILTER (e) AS exp_lines, count(*) FILTER (e AND m) AS metrics, count(*) FILTER (e AND a) AS actions, count(*) FILTER (e AND r) AS results, count(*) FILTER (dt) AS dates, least(count(*) FILTER (vague), 5) AS vague,
    least(count(*) FILTER (size > 90), 5) AS long, least(count(*) FILTER (weak), 5) AS weak, least(count(*) FILTER (title), 3) AS role_titles, {_NAMES('size > 90', 5)} AS long_lines, {_NAMES('e AND m', 3)} AS metric_lines, {_NAMES('e AND a', 3)} AS action_lines,
    {_NAMES('course', 5)} AS course_lines, {_NAMES('len(ds) > 0', 6)} AS domain_lines, flatten(list(ds)) AS words, list(DISTINCT section) AS there, min(line_no) FILTER (e AND kind = 'duty' AND size < 40 AND NOT m) AS short_line FROM z GROUP BY 1)
SELECT *, len(list_filter(zones, lambda t: starts_with(t, 'weak'))) AS duty_zones,
  CASE WHEN exp_lines = 0 THEN 0.4 ELSE round(least(greatest(0.55 + 0.12 * least(metrics, 4) + 0.08 * least(results, 3) - 0.07 * least(weak, 4) - 0.05 * least(vague, 3), 0.2), 0.95), 2) END AS confidence
FROM (SELECT g.* EXCLUDE (words, there, short_line), k.* EXCLUDE (doc_id), coalesce(zones, CASE WHEN short_line IS NOT NULL THEN ['short:' || short_line] ELSE [] END) AS zones, list_filter({_DOMAINS}, lambda d: list_contains(words, d))[1:12] AS domain_words,
  list_filter(['basic_info', 'education', 'internship', 'projects', 'skills'], lambda s: NOT list_contains(there, s)) AS missing FROM g JOIN k USING (doc_id) LEFT JOIN zone USING (doc_id))"""

_STEP_TO = """CASE kind WHEN 'skills' THEN 'skills' WHEN 'award' THEN 'awards' WHEN 'education' THEN 'education' ELSE
    CASE WHEN kind IN ('duty', 'role_title') AND {0} NOT IN ('internship', 'projects', 'campus') THEN 'internship' ELSE {0} END END"""
_INFERRED = f"""SELECT doc_id, line_no, CASE WHEN NOT has AND now = 'skills' AND regexp_matches(lower(line), '{_u(dict(LATIN.line_classes)["education"])}') THEN 'education' ELSE now END AS section, kind FROM (
  SELECT *, bool_or(now = 'education') OVER (PARTITION BY doc_id) AS has FROM (
    WITH RECURSIVE k AS MATERIALIZED (SELECT *, {_CLASS('line')} AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM seg),
    walk AS (
      SELECT doc_id, line_no, line, kind, i, section, {_STEP_TO.format('section')} AS now FROM k WHERE i = 1
      UNION ALL
      SELECT doc_id, line_no, line, kind, i, section, {_STEP_TO.format('base')} FROM (SELECT k.*, CASE WHEN k.section <> w.section THEN k.section ELSE w.now END AS base FROM walk w JOIN k ON k.doc_id = w.doc_id AND k.i = w.i + 1))
    SELECT * FROM walk))"""


def sql(text: str) -> str:
    return duck(text, wanted=_WANTED, seg=_SEG, norm_lines=_NORM, page=_PAGE, lay=_LAY, pool=_POOL, found=_FOUND, judged=_QUALITY, content=_CONTENT, card=_CARD, idf=_IDF, term=_TERM, term_name=_NAME)


_COSINE = f"""WITH a AS (SELECT doc_id, term, count(*) FILTER (own) * coalesce(any_value(idf), 1) AS w, count(*) * coalesce(any_value(idf), 1) AS x FROM (SELECT doc_id, unnest({_TOKENS}) AS term, true AS own FROM (SELECT doc_id, {_WORD} AS w FROM documents) UNION ALL SELECT doc_id, unnest({_ROOTS}), false FROM documents) LEFT JOIN idf USING (term) GROUP BY ALL),
        b AS (SELECT item_id, term, count(*) FILTER (own) * coalesce(any_value(idf), 1) AS w, count(*) * coalesce(any_value(idf), 1) AS x FROM (SELECT item_id, unnest({_TOKENS}) AS term, true AS own FROM (SELECT item_id, {_WORD} AS w FROM benchmark) UNION ALL SELECT item_id, unnest({_ROOTS}), false FROM benchmark) LEFT JOIN idf USING (term) GROUP BY ALL),
        na AS (SELECT doc_id, sqrt(sum(w * w)) AS n, sqrt(sum(x * x)) AS m FROM a GROUP BY 1), nb AS (SELECT item_id, sqrt(sum(w * w)) AS n, sqrt(sum(x * x)) AS m FROM b GROUP BY 1)
        SELECT doc_id, item_id, cosine, least(0.88, 0.45 + 0.42 * cosine) AS confidence FROM (SELECT doc_id, item_id, greatest(sum(a.w * b.w / na.n / nb.n), sum(a.x * b.x / na.m / nb.m)) AS cosine FROM a JOIN b USING (term) JOIN na USING (doc_id) JOIN nb USING (item_id) GROUP BY ALL)"""
SQL = {
    "h1_norm_line": sql("SELECT * FROM norm_lines"),
    "h2_job_tokens": r"SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]+|[\x{4e00}-\x{9fa5}]{2,}') AS l FROM documents)",
    "h2_vector_tokens": f"SELECT doc_id, {_TOKENS} AS tokens FROM (SELECT doc_id, {_WORD} AS w FROM documents)",
    "h3_contains_kw": "SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9+#.])the\\.*($|[^a-z0-9+#.])') AS the, contains(lower(text), 'c3') AS c3, regexp_matches(lower(text), '(^|[^a-z0-9+#.])onre\\.*($|[^a-z0-9+#.])') AS onre FROM documents",
    "h4_contacts": duck(
        f"""SELECT doc_id, regexp_extract(text, '{T.EMAIL}') AS email, coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(text, '(^|[^0-9])({T.MOBILE})([^0-9]|$)', 2), '[^0-9]', '', 'g'), '^86', ''), ''), regexp_replace(regexp_extract(text, '{T.PHONE}'), '^\\+[0-9]{{1,3}}[ -]?', '')) AS phone,
        regexp_extract(text, '(?i)(?:微信|Wechat)\\s*[:：]?\\s*([A-Za-z0-9_-]{{3,30}})', 1) AS wechat, regexp_extract(text, '(?:QQ|qq)\\s*[:：]?\\s*([1-9][0-9]{{4,11}})', 1) AS qq,
        regexp_extract(text, '(?i)(?:salary|gehalt|salaire)\\s*[:=]\\s*([0-9kK -]+)', 1) AS salary,
        coalesce(nullif(regexp_extract(text, '(?:现居|现居地|居住地|所在地|地址)\\s*[:：]?\\s*([{T.HAN}A-Za-z]{{2,20}})', 1), ''), regexp_extract(text, '(?i)(?:location|address|ort|ville)\\s*[:=]\\s*([^\\n,;]{{2,40}})', 1)) AS location,
        CASE WHEN {_is_name(_LABEL)} THEN {_LABEL} ELSE coalesce(list_filter({_CELLS}, lambda z: {_is_name('z')})[1], '') END AS name FROM v_resume"""
    ),
    "h4_name_in_sections": duck(
        rf"""WITH r AS (SELECT doc_id, CAST(i AS INT) AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM v_resume) WHERE length(trim(l[i])) > 0),
        s AS (SELECT doc_id, line_no, trim(regexp_replace(replace(replace(line, chr(12288), ' '), chr(160), ' '), '\s+', ' ', 'g')) AS text,
          coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'basic_info') AS section FROM r LEFT JOIN ({_HEAD}) h(word, section) ON word = lower(regexp_extract(trim(line), '^[A-Za-z]+'))),
        c AS (SELECT doc_id, section, line_no, CASE WHEN {_is_name(_LABEL)} THEN {_LABEL} WHEN {_is_name('text')} THEN text END AS name FROM s WHERE section IN ('basic_info', 'summary')),
        f AS (SELECT doc_id, arg_min(name, (section, line_no)) AS in_section FROM c WHERE name IS NOT NULL GROUP BY 1)
        SELECT doc_id, CASE WHEN {_is_name(_LABEL)} THEN {_LABEL} ELSE coalesce(in_section, list_filter({_CELLS}, lambda z: {_is_name('z')})[1], '') END AS name FROM v_resume LEFT JOIN f USING (doc_id)"""
    ),
    "h5_redact": duck(_redact() + f" SELECT doc_id, {_SQUEEZED} AS text, {_KINDS} FROM r_name"),
    "h6_residual_pii": "SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p, _ in T.PII) + "], lambda x: x IS NOT NULL) AS kinds FROM documents",
    "d18_redaction_report": duck(
        _redact() + " SELECT kind, sum(n) AS total, count(*) FILTER (n > 0) AS documents FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS n FROM r_name" for k in T.KINDS)
        + f" UNION ALL SELECT 'needs_review', CAST({' OR '.join(f"regexp_matches(text, '{p}')" for _, p, _ in T.PII)} AS INT) FROM r_name UNION ALL SELECT 'empty', CAST(trim(text) = '' AS INT) FROM r_name) GROUP BY 1"
    ),
    "h7_visible_text": sql("SELECT page_id, text FROM page"),
    "h8_page_title": sql("SELECT page_id, title FROM page"),
    "h9_infer_degree": sql(f"SELECT page_id, {_degree('minimum', 'preferred')} FROM page"),
    "h10_skill_mentions": sql(f"SELECT page_id, {_SKILLS} AS skills FROM page"),
    "a6_pages_to_jobs": sql(f"SELECT page_id, title, {_degree('degree_minimum', 'degree_preferred')}, {_SKILLS} AS skill_mentions, 'pending' AS review_status FROM page"),
    "h16_line_class": sql(f"SELECT doc_id, line_no, {_CLASS('line')} AS kind FROM v_line"),
    "h17_evidence": sql(_EVIDENCE),
    "h30_layout_parser": sql(
        f"SELECT doc_id, lines, short, tables, long, CAST(round({_STEP.format('short')} + CASE WHEN long >= 2 THEN 0.6 ELSE 0 END, 3) AS DOUBLE) AS complexity, list_filter([CASE WHEN tables >= 2 THEN 'table' END, CASE WHEN short / lines >= 0.2 THEN 'fragments' END, CASE WHEN long >= 2 THEN 'long_lines' END, CASE WHEN lines < 8 THEN 'few_lines' END], lambda x: x IS NOT NULL) AS tags FROM lay"
    ),
    "h30_layout_pool": sql("SELECT doc_id, complexity FROM pool"),
    "h30_junk_ratio": sql("SELECT doc_id, junk / lines AS junk FROM lay"),
    "h31_content_quality": sql("SELECT doc_id, has_intent, rich, metrics, content_quality, a_score, b_score FROM content"),
    "h32_parse_quality": sql("SELECT doc_id, quality, warnings FROM judged"),
    "h33_target_from_name": sql(
        r"SELECT file_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(name, '\.[A-Za-z]+$', ''), '^~\$', ''), '[-_/|,\s]+'), lambda p: trim(p)), lambda p: p <> '' AND NOT regexp_matches(p, '^[0-9]+$'))[1:3], ' ') AS target FROM v_file"
    ),
    "h34_normalise_sections": sql("SELECT doc_id, min(line_no) AS line_no, section, trim(line) AS line FROM seg WHERE trim(line) <> '' GROUP BY doc_id, section, trim(line)"),
    "h35_infer_sections": sql(_INFERRED),
    "h36_section_blocks": sql(
        f"""SELECT doc_id, section, lines, confidence, CASE WHEN confidence >= 0.85 THEN 'complete' WHEN confidence >= 0.65 THEN 'basic' ELSE 'weak' END AS label FROM (SELECT s.*, round(CASE quality WHEN 'low' THEN 0.45 ELSE
        least(CASE quality WHEN 'high' THEN 0.9 ELSE 0.72 END + least(0.08, 0.02 * lines) + CASE WHEN section IN ('internship', 'projects', 'education', 'skills') THEN 0.05 ELSE 0 END + CASE WHEN structured THEN 0.04 ELSE 0 END, 0.98) END, 2) AS confidence
        FROM (SELECT doc_id, section, count(*) AS lines, bool_or(regexp_matches(line, '{L.DATE}')) AS structured FROM seg GROUP BY ALL) s JOIN judged USING (doc_id))"""
    ),
    "h36_missing_sections": sql("SELECT doc_id, list_filter(['basic_info', 'education', 'internship', 'projects', 'skills'], lambda s: NOT list_contains(sections, s)) AS missing FROM found"),
    "h37_json_or": "SELECT event_id, coalesce(list_sort(json_keys(TRY_CAST(props AS JSON))), []) AS keys FROM events",
    "h38_grade": sql(
        "SELECT record_id, CASE WHEN total_score >= 90 THEN 'excellent' WHEN total_score >= 80 THEN 'good' WHEN total_score >= 70 THEN 'fair' WHEN total_score >= 60 THEN 'pass' ELSE 'weak' END AS grade, CASE status WHEN 'success' THEN 'done' WHEN 'failed' THEN 'error' ELSE status END AS label FROM v_record"
    ),
    "h39_boundary_card": sql("SELECT * FROM card"),
    "d23_boundary_summary": sql("SELECT quality, count(*) AS n, CASE WHEN quality = 'low' THEN count(*) ELSE 0 END AS low FROM card GROUP BY 1"),
    "h40_excerpt": sql(
        f"SELECT doc_id, CASE WHEN length(string_agg(trim(line), chr(10) ORDER BY line_no)) <= 400 THEN string_agg(trim(line), chr(10) ORDER BY line_no) ELSE substr(string_agg(trim(line), chr(10) ORDER BY CASE WHEN regexp_matches(lower(line), '{_u(PRIORITY)}') THEN 0 ELSE 1 END, line_no), 1, 400) END AS excerpt FROM v_line GROUP BY 1"
    ),
    "e5_assign_pools": sql(
        "SELECT doc_id, CASE WHEN b <= 30 THEN 'B' WHEN a <= 50 THEN 'A' ELSE 'C' END AS pool FROM (SELECT *, row_number() OVER (PARTITION BY b <= 30 ORDER BY a_score DESC, rich DESC, metrics DESC, size DESC, doc_id) AS a FROM (SELECT *, row_number() OVER (ORDER BY b_score DESC, complexity DESC, size, doc_id) AS b FROM content))"
    ),
    "e12_hit_spans": f"""WITH p AS (SELECT doc_id, t, string_split(lower(text), t) AS p FROM documents, (VALUES {", ".join(f"('{t}')" for t in SPAN_TERMS)}) v(t)),
        piece AS (SELECT doc_id, t, length(unnest(p)) AS n, generate_subscripts(p, 1) AS i, len(p) AS k FROM p),
        span AS (SELECT doc_id, place AS start, place + length(t) AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, t ORDER BY i) + (i - 1) * length(t) AS place FROM piece) WHERE i < k),
        opened AS (SELECT *, CASE WHEN start >= max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM span)
        SELECT doc_id, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM opened) GROUP BY doc_id, island""",
    "e14_merge_label_lines": sql(
        """SELECT doc_id, line_no, CASE WHEN l AND coalesce(next_v, false) THEN regexp_replace(norm, '[.:]+$', '') || ': ' || next_line ELSE norm END AS line FROM (SELECT *, lead(v) OVER w AS next_v, lead(norm) OVER w AS next_line, lag(l) OVER w AS last_l
        FROM (SELECT *, regexp_matches(norm, '^[A-Za-z]{1,12}[.:]?$') AS l, NOT regexp_matches(norm, '^[A-Za-z]{1,12}[.:]?$') AND length(norm) <= 40 AS v FROM norm_lines) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) WHERE NOT (v AND coalesce(last_l, false))"""
    ),
    "e15_segment_by_heading": sql("SELECT doc_id, line_no, section FROM seg"),
    "e17_dedupe_lines": sql("SELECT doc_id, min(line_no) AS line_no, section, canon FROM seg JOIN norm_lines USING (doc_id, line_no) WHERE canon <> '' GROUP BY doc_id, section, canon"),
    "e18_top_keywords": sql(
        f"""SELECT doc_id, keyword, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, rank, keyword) AS place FROM (
        SELECT doc_id, p AS keyword, 0 AS kind, i AS rank FROM documents JOIN (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(PHRASES))}) h(i, p) ON contains(lower(text), p)
        UNION ALL SELECT doc_id, w, 1, -count(*) FROM (SELECT doc_id, text, unnest({_WORD}) AS w FROM documents) WHERE length(w) >= 2 AND w NOT IN ({", ".join(f"'{s}'" for s in LATIN.stop_words)})
          AND NOT (w IN ({", ".join(f"'{p}'" for p in PHRASES)}) AND contains(lower(text), w)) GROUP BY doc_id, w)) WHERE place <= 30"""
    ),
    "c8_match_terms": sql(
        f"SELECT DISTINCT doc_id, term FROM ({_RUN.format('doc_id', 'text', 'documents')}) JOIN term_name USING (name) WHERE regexp_matches(name, '^[a-z+#.]{{2,}}$') UNION SELECT doc_id, term FROM documents JOIN term_name ON NOT regexp_matches(name, '^[a-z+#.]{{2,}}$') AND contains(lower(text), name)"
    ),
    "c9_hit_sections": sql(
        f"SELECT DISTINCT doc_id, section, name AS term FROM ({_RUN.format('doc_id, section', 'line', 'seg')}) JOIN term ON name = term WHERE regexp_matches(name, '^[a-z+#.]{{2,}}$') UNION SELECT doc_id, section, term FROM seg JOIN term ON NOT regexp_matches(term, '^[a-z+#.]{{2,}}$') AND contains(lower(line), term)"
    ),
    "d21_fit_idf": sql("SELECT * FROM idf"),
    "h20_tfidf_cosine": sql(_COSINE),
    "h20_cosine_join": sql(f"SELECT * FROM ({_COSINE}) WHERE cosine >= {LEAST_COSINE}"),
    "c8_match_phrases": sql(
        "SELECT doc_id, term FROM documents JOIN (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark))) ON contains(lower(text), term) GROUP BY ALL"
    ),
    "h21_vector_cosine": "SELECT vec_id, c AS cosine, least(greatest(0.65 * 40 + 0.35 * c * 100, 0), 100) AS fused FROM (SELECT a.vec_id, least(greatest(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 1) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10)",
}
