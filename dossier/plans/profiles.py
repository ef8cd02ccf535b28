"""Queries over scores, entries and event logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import DEFAULT_WEIGHTS, DIMENSIONS, LATIN
from ..operators import lines as L
from ..operators import scoring as S
from ..operators import terms as M
from ..sources import files as A
from . import texts
from .texts import found, segmented
from .views import AS_OF, Views, duck

HEADER = r"^(on|la|der|and)\b"


def inputs(v: Views):
    seg = segmented(v)
    k = F.col("doc_id")
    counts = S.section_counts(seg)
    own = L.parse_quality(found(v)).select("doc_id", "quality", "has_contact", "complexity")
    rows = own.join(counts, "doc_id").join(L.evidence(seg, LATIN), "doc_id")
    return rows.withColumns({"job_match": (k % 101).cast("double"), "match_rate": (k % 11) / 10, "has_target": k % 2 == 0})


def schooled(v: Views):
    """Half of the documents with lines that name a school, which the table does not."""
    k, line = F.col("doc_id") % 4, F.col("line")
    more = F.when(k == 0, "北方工业大学 软件工程 bachelor 2018.09-2022.06").when(k == 1, F.concat(F.lit("Example University, "), F.substring(line, 1, 12))).when(k == 2, F.concat(F.lit("Major: Physics "), line))
    return segmented(v).withColumn("line", F.coalesce(more, line))


def scored(v: Views):
    return S.score_documents(inputs(v))


def advised(v: Views):
    """Scored documents whose position asks for the rule set's domain words."""
    missing = F.array_except(F.array(*map(F.lit, LATIN.domains)), F.col("domain_words"))
    return S.advice_items(scored(v).withColumns({"missing_keywords": missing, "hit_keywords": F.col("domain_words")}))


def skill_hits(v: Views):
    terms = v.spark.createDataFrame([(t,) for t in LATIN.skills], "term string")
    return M.hit_sections(segmented(v), terms).withColumn("root", F.col("term"))


def weights(v: Views):
    k = F.col("c_custkey")
    return v.customer.select(k.alias("user_id"), F.when(k % 3 == 0, F.create_map(F.lit("job_match"), (k % 7).cast("double"), F.lit("highlight_strength"), F.lit(2.0), F.lit("other"), F.lit(1.0))).alias("w"))


def dates(v: Views):
    day = F.date_format("o_orderdate", "yyyy.MM")
    k = F.col("o_orderkey")
    return v.orders.select("o_orderkey", F.when(k % 4 == 0, F.concat(day, F.lit(" - present"))).when(k % 4 == 1, F.concat(F.substring(day, 1, 4), F.lit("-"), (F.substring(day, 1, 4).cast("int") + 1).cast("string"))).when(k % 4 == 2, F.concat(day, F.lit("-"), F.lit("2001.09"))).otherwise("no dates").alias("s"))


def synonyms(v: Views):
    return v.v_job.select(F.element_at("must", 1).alias("root"), F.slice("must", 2, 3).alias("aliases"))


def nodes(v: Views):
    return v.v_job.where("job_id % 2 = 0").select(F.element_at("nice", 1).alias("name"), F.slice("must", 1, 2).alias("aliases"))


QUERIES = {
    "a5_load_aliases": lambda v: A.load_aliases(synonyms(v), nodes(v)),
    "h15_normalise_weights": lambda v: weights(v).select("user_id", S.normalise_weights(F.coalesce("w", F.create_map().cast("map<string,double>"))).alias("w")).select("user_id", *(F.coalesce(F.try_element_at("w", F.lit(d)), F.lit(0.0)).alias(d) for d in DIMENSIONS)),
    "h18_score_documents": lambda v: scored(v).select("doc_id", *(f"s_{d}" for d in DIMENSIONS), "total", "coverage", "reliability"),
    "h19_advice": lambda v: S.advice(scored(v)),
    "h19_advice_items": lambda v: advised(v).select("doc_id", F.transform("items", lambda x: F.concat_ws("|", x["problem"], x["evidence"], x["direction"])).alias("items")),
    "h19_rewrite_candidates": lambda v: S.rewrite_candidates(segmented(v), LATIN),
    "h27_date_range": lambda v: dates(v).select("o_orderkey", T.date_range(F.col("s"), AS_OF).alias("r")).select("o_orderkey", F.col("r.start").cast("string").alias("start"), F.col("r.end").cast("string").alias("end"), "r.months"),
    "e13_merged_months": lambda v: S.merged_months(v.v_interval),
    "h28_education_entries": lambda v: S.education_entries(schooled(v), LATIN, AS_OF),
    "h28_award_entries": lambda v: S.award_entries(segmented(v)),
    "h28_experience_blocks": lambda v: S.experience_blocks(segmented(v), HEADER),
    "h29_canonical_skills": lambda v: S.canonical_skills(skill_hits(v)),
    "d22_profile_stats": lambda v: S.profile_stats(S.canonical_skills(skill_hits(v)), S.education_entries(segmented(v), LATIN, AS_OF), S.award_entries(segmented(v)), v.documents.select("doc_id", (F.col("doc_id") % 40).alias("months"))),
    "s1_analysis_events": lambda v: S.analysis_events(v.documents.select("doc_id", F.col("n_chars").alias("total")), skill_hits(v), L.missing_sections(found(v))),
}

_RANGE = r"(?i)([0-9]{4})(?:[./-]([0-9]{1,2}))?\s*(?:-|to|until)\s*(?:([0-9]{4})(?:[./-]([0-9]{1,2}))?|(present|now|today))"
_DEGREE = "CASE " + " ".join(f"WHEN regexp_matches(lower(line), '{texts._u(p)}') THEN '{n}'" for n, _, p in LATIN.degrees) + " ELSE '' END"
_REST = f"regexp_replace(regexp_extract(line, '{S.SCHOOL}(.*)$', 1), '{S.RANGE}', '', 'g')"
for _, _, _p in LATIN.degrees:
    _REST = f"regexp_replace({_REST}, '(?i){_p}', '', 'g')"
_SHARE = "CASE WHEN n_{0} >= 4 THEN 13 WHEN n_{0} > 0 THEN 8 ELSE 0 END"
_CORE = ("basic_info", "education", "internship", "projects", "skills")
_ALL = (*_CORE, "campus", "awards", "summary")
_COUNTS = "SELECT doc_id, " + ", ".join(f"count(*) FILTER (section = '{s}') AS n_{s}" for s in _ALL) + f", count(*) AS n_lines, avg(length(line)) AS mean_length, bool_or(regexp_matches(line, '{L.DATE}')) AS any_date FROM seg GROUP BY 1"
_EVID = texts._EVIDENCE
_IN = "SELECT *, CAST(doc_id % 101 AS DOUBLE) AS job_match, (doc_id % 11) / 10 AS match_rate, doc_id % 2 = 0 AS has_target, quality = 'low' AS low FROM (SELECT doc_id, quality, has_contact, complexity FROM judged) JOIN counts USING (doc_id) JOIN evid USING (doc_id)"
_MISSING = " + ".join(f"CAST(n_{s} = 0 AS INT)" for s in _CORE)
_THERE = " + ".join(f"CAST(n_{s} > 0 AS INT)" for s in _ALL)
_RAW = f"""
SELECT *, greatest(least(CASE WHEN low THEN least(c0, 52) ELSE c0 - CASE WHEN miss >= 3 THEN 8 ELSE 0 END END, 100), 35) AS c, greatest(least(CASE WHEN low THEN least(e0, 50) ELSE e0 END, 100), 35) AS e,
  greatest(least(CASE WHEN low THEN least(l0, 55) ELSE l0 END, 100), 35) AS l, greatest(least(f0, 100), 30) AS f, greatest(least(CASE WHEN low THEN least(h0, 50) ELSE h0 END, 100), 35) AS h FROM (
SELECT *, {_MISSING} AS miss, 35 + {' + '.join(_SHARE.format(s) for s in _CORE)} + CASE WHEN n_awards > 0 THEN 4 ELSE 0 END + CASE WHEN n_campus > 0 THEN 3 ELSE 0 END AS c0,
  42 + 3 * least(exp_lines, 12) + 4 * least(actions, 6) + 6 * least(metrics, 5) + 4 * least(results, 5) + CASE WHEN n_internship > 0 AND n_projects > 0 THEN 6 ELSE 0 END - CASE WHEN exp_lines = 0 AND NOT low THEN 12 ELSE 0 END AS e0,
  62 + 4 * least(actions, 7) + 3 * least(results, 4) - 5 * least(vague, 5) - 3 * least(long, 5) AS l0,
  CASE WHEN n_lines = 0 THEN 55 ELSE 78 END - CASE WHEN mean_length > 85 THEN 12 ELSE 0 END - CASE WHEN n_lines < 8 THEN 14 ELSE 0 END + CASE WHEN {_THERE} >= 5 THEN 8 ELSE 0 END + CASE WHEN has_contact THEN 6 ELSE 0 END + CASE WHEN any_date THEN 4 ELSE 0 END AS f0,
  45 + 7 * least(metrics, 6) + 5 * least(results, 5) + CASE WHEN metrics > 0 THEN 6 WHEN NOT low THEN -8 ELSE 0 END AS h0 FROM inp)"""
_PEN = """
SELECT *, CASE WHEN strong THEN least(10, 3 + 2 * duty_zones) ELSE 0 END AS p, CASE WHEN strong THEN greatest(2, least(10, 3 + 2 * duty_zones) // 2) WHEN len(zones) > 0 AND confidence < 0.45 THEN least(6, greatest(2, 2 * duty_zones)) ELSE 0 END AS q
FROM (SELECT *, duty_zones > 0 AND (job_match >= 65 OR e >= 65) AND confidence < 0.55 AS strong FROM rawscore)"""
_W = DEFAULT_WEIGHTS
_FINAL = f"""
SELECT *, CASE WHEN low THEN 'low_parse_capped' WHEN complexity >= 3.5 THEN 'layout_review' WHEN coverage < 0.5 THEN 'evidence_review' ELSE 'normal' END AS reliability FROM (
SELECT *, CAST(CASE WHEN low THEN least(t, 58) ELSE t END AS DOUBLE) AS total, round(greatest(least(CASE WHEN has_target THEN 0.5 * share + 0.3 * match_rate + 0.2 * confidence ELSE share END, 1), 0), 3) AS coverage FROM (
SELECT *, round({_W['content_completeness']} * c + {_W['experience_match']} * (e - p) + {_W['language_professionalism']} * l + {_W['format_standardization']} * f + {_W['highlight_strength']} * (h - q) + {_W['job_match']} * job_match + 1e-9, 1) AS t,
  {' + '.join(f'CASE WHEN n_{s} > 0 THEN 0.25 ELSE 0 END' for s in ('education', 'internship', 'projects', 'skills'))} AS share FROM pen))"""
_cap = lambda c: f"CAST(CASE WHEN low THEN least({c}, 62) ELSE {c} END AS DOUBLE)"
_DATED = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 1 THEN make_date(year(o_orderdate), 1, 1) ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS s,
  CASE o_orderkey % 4 WHEN 0 THEN DATE '2001-08-01' WHEN 1 THEN make_date(year(o_orderdate) + 1, 12, 1) WHEN 2 THEN DATE '2001-09-01' END AS e FROM orders"""
_SKILL = "SELECT DISTINCT doc_id, section, t.term FROM (SELECT DISTINCT doc_id, section, rtrim(unnest(regexp_extract_all(lower(line), '[a-z0-9+#.]+')), '.') AS term FROM seg) JOIN (VALUES " + ", ".join(f"('{s}')" for s in LATIN.skills) + ") t(term) USING (term)"
_CANON = """
SELECT doc_id, term AS root, arg_max(source, (confidence, source)) AS source, max(confidence) AS confidence FROM (SELECT *, CASE WHEN section = 'skills' THEN 'skills_section' WHEN section IN ('internship', 'projects', 'campus') THEN 'implicit' ELSE 'lexicon' END AS source,
  CASE WHEN section IN ('internship', 'projects', 'campus') THEN 0.72 ELSE 0.9 END AS confidence FROM skillhit) GROUP BY ALL"""
_DEG = "CASE " + " ".join(f"WHEN regexp_matches(lower(line), '{texts._u(p)}') THEN '{n}'" for n, _, p in LATIN.degrees) + " ELSE '' END"
_EDU = f"SELECT doc_id, line_no, {_DEG} AS degree FROM seg WHERE section = 'education'"


_SCORES = {"content_completeness": "c", "experience_match": "e - p", "language_professionalism": "l", "format_standardization": "f", "highlight_strength": "h - q", "job_match": "job_match"}
_SHOWN = {"experience_match": "CAST(weak_lines[1] AS VARCHAR)", "highlight_strength": "CAST(metrics AS VARCHAR)", "job_match": "nullif(array_to_string(wanting[1:3], ','), '')"}
_LOW = ", ".join(f"CASE WHEN {_cap(c)} < 60 THEN 'low_{d}|' || coalesce({_SHOWN.get(d, 'NULL')}, CAST(CAST(floor({_cap(c)}) AS BIGINT) AS VARCHAR)) || '|fill_section' END" for d, c in _SCORES.items())
_ITEMS = f"""
SELECT doc_id, CASE WHEN low THEN ['no_text||save_as_text'] WHEN len(listed) = 0 THEN ['complete||tune'] ELSE list_filter(listed, lambda x, i: list_position(listed, x) = i)[1:8] END AS items FROM (
  SELECT *, list_concat(named, weak_dims[1:greatest(0, 8 - len(named))]) AS listed FROM (
    SELECT *, list_concat(first_ones, list_transform(domain_words[1:least(2, greatest(1, 6 - len(first_ones)))], lambda k: 'matched_keyword|' || k || '|move_forward'), CASE WHEN metrics < 2 THEN ['few_metrics|' || metrics || '|add_metrics'] ELSE [] END) AS named,
      list_filter([{_LOW}], lambda x: x IS NOT NULL) AS weak_dims FROM (
      SELECT *, list_concat(list_transform(weak_lines[1:2], lambda n: 'no_result|' || n || '|tell_result'), list_transform(wanting[1:3], lambda k: 'missing_keyword|' || k || '|use_keyword')) AS first_ones FROM (
        SELECT *, list_filter({texts._DOMAINS}, lambda d: NOT list_contains(domain_words, d)) AS wanting FROM final))))"""


def sql(text: str) -> str:
    return duck(
        text, seg=texts._SEG, lay=texts._LAY, pool=texts._POOL, wanted=texts._WANTED, found=texts._FOUND, judged=texts._QUALITY, counts=_COUNTS, evid=_EVID, inp=_IN, rawscore=_RAW, pen=_PEN, final=_FINAL, dated=_DATED, skillhit=_SKILL, canonical=_CANON, edu=_EDU,
    )


SQL = {
    "a5_load_aliases": sql(
        "SELECT alias, arg_min(root, (k, root)) AS root FROM (SELECT must[1] AS root, unnest(list_concat([must[1]], must[2:4])) AS alias, 1 AS k FROM v_job UNION ALL SELECT nice[1], unnest(list_concat([nice[1]], must[1:2])), 0 FROM v_job WHERE job_id % 2 = 0) WHERE alias <> '' AND root <> '' GROUP BY 1"
    ),
    "h15_normalise_weights": "SELECT c_custkey AS user_id, " + ", ".join(
        f"CASE WHEN c_custkey % 3 = 0 THEN {'round((c_custkey % 7) / (c_custkey % 7 + 2.0), 4)' if d == 'job_match' else 'round(2.0 / (c_custkey % 7 + 2.0), 4)' if d == 'highlight_strength' else '0.0'} ELSE {w} END AS {d}" for d, w in DEFAULT_WEIGHTS.items()
    ) + " FROM customer",
    "h18_score_documents": sql(f"SELECT doc_id, {_cap('c')} AS s_content_completeness, {_cap('e - p')} AS s_experience_match, {_cap('l')} AS s_language_professionalism, {_cap('f')} AS s_format_standardization, {_cap('h - q')} AS s_highlight_strength, {_cap('job_match')} AS s_job_match, total, coverage, reliability FROM final"),
    "h19_advice": sql("SELECT doc_id, codes, codes[1:5] AS roadmap FROM (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {w} THEN '{c}' END" for c, w in S.ADVICE) + "], lambda x: x IS NOT NULL) AS codes FROM inp)"),
    "h19_advice_items": sql(_ITEMS),
    "h19_rewrite_candidates": sql(
        f"SELECT doc_id, line_no, kind, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY line_no) AS place FROM (SELECT *, CASE WHEN regexp_matches(lower(line), '{texts._u(LATIN.vague)}') THEN 'vague' WHEN length(line) > 90 THEN 'long' WHEN NOT regexp_matches(lower(line), '[0-9]') THEN 'no_metric' END AS kind FROM seg WHERE section IN ('internship', 'projects', 'campus')) WHERE kind IS NOT NULL) WHERE place <= CASE kind WHEN 'long' THEN 2 ELSE 3 END"
    ),
    "h27_date_range": sql("SELECT o_orderkey, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS end, CASE WHEN e >= s THEN date_diff('month', s, e) + 1 END AS months FROM dated"),
    "e13_merged_months": sql(
        "SELECT person_id, count(*) AS months, count(*) FILTER (gap IS NULL OR gap > 1) AS spans FROM (SELECT person_id, m, m - lag(m) OVER (PARTITION BY person_id ORDER BY m) AS gap FROM (SELECT DISTINCT person_id, unnest(range(start_m, end_m + 1)) AS m FROM v_interval)) GROUP BY 1"
    ),
    "h28_education_entries": sql(
        f"""SELECT doc_id, line_no, school, degree, major, CAST(start AS VARCHAR) AS start, CASE WHEN fin >= start THEN datediff('month', start, fin) + 1 END AS months,
        round(least(0.55 + CASE WHEN school <> '' THEN 0.2 ELSE 0 END + CASE WHEN degree <> '' THEN 0.1 ELSE 0 END + CASE WHEN major <> '' THEN 0.1 ELSE 0 END + CASE WHEN start IS NOT NULL THEN 0.05 ELSE 0 END, 0.98), 2) AS confidence FROM (
        SELECT *, CASE WHEN named <> '' THEN named WHEN school <> '' AND length(rest) BETWEEN 2 AND 24 AND NOT regexp_matches(rest, '负责|参与|奖') THEN rest ELSE '' END AS major,
          CASE WHEN y1 <> '' THEN make_date(CAST(y1 AS INT), CAST(CASE WHEN m1 = '' THEN 1 ELSE least(greatest(CAST(m1 AS INT), 1), 12) END AS INT), 1) END AS start,
          CASE WHEN now <> '' THEN date_trunc('month', DATE '{AS_OF}') WHEN y2 <> '' THEN make_date(CAST(y2 AS INT), CAST(CASE WHEN m2 = '' THEN 12 ELSE least(greatest(CAST(m2 AS INT), 1), 12) END AS INT), 1) END AS fin
        FROM (SELECT *, trim(regexp_extract(line, '{S.SCHOOL}')) AS school, {_DEGREE} AS degree, regexp_replace({_REST}, '{S.EDGES}', '', 'g') AS rest, regexp_extract(line, '{S.MAJOR}', 1) || regexp_extract(line, '{S.MAJOR}', 2) AS named,
          regexp_extract(line, '{_RANGE}', 1) AS y1, regexp_extract(line, '{_RANGE}', 2) AS m1, regexp_extract(line, '{_RANGE}', 3) AS y2, regexp_extract(line, '{_RANGE}', 4) AS m2, regexp_extract(line, '{_RANGE}', 5) AS now
        FROM (SELECT doc_id, line_no, CASE doc_id % 4 WHEN 0 THEN '北方工业大学 软件工程 bachelor 2018.09-2022.06' WHEN 1 THEN 'Example University, ' || line[1:12] WHEN 2 THEN 'Major: Physics ' || line ELSE line END AS line FROM seg WHERE section = 'education')))
        WHERE school <> '' OR degree <> '' OR start IS NOT NULL"""
    ),
    "h28_award_entries": sql(f"SELECT doc_id, line_no, regexp_extract(line, '{L.DATE}') AS year, CASE WHEN regexp_extract(line, '{L.DATE}') <> '' THEN 0.8 ELSE 0.6 END AS confidence FROM seg WHERE section = 'awards'"),
    "h28_experience_blocks": sql(
        f"SELECT doc_id, section, block, min(line_no) AS first_line, sum(1 - head) AS bullets FROM (SELECT *, sum(head) OVER (PARTITION BY doc_id, section ORDER BY line_no) AS block FROM (SELECT *, CAST(regexp_matches(lower(line), '{texts._u(HEADER)}') AS INT) AS head FROM seg WHERE section IN ('internship', 'projects', 'campus'))) GROUP BY ALL"
    ),
    "h29_canonical_skills": sql("SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, root) AS place FROM canonical"),
    "d22_profile_stats": sql(
        f"""SELECT doc_id, count(*) AS skills, count(*) FILTER (source = 'implicit') AS implicit, round(avg(confidence), 2) AS confidence, coalesce(any_value(e.n), 0) AS education, coalesce(any_value(a.n), 0) AS awards, doc_id % 40 AS months, round((doc_id % 40) / 12, 2) AS years
        FROM canonical LEFT JOIN (SELECT doc_id, count(*) AS n FROM seg WHERE section = 'education' AND ({_DEGREE} <> '' OR trim(regexp_extract(line, '{S.SCHOOL}')) <> '' OR regexp_extract(line, '{_RANGE}', 1) <> '') GROUP BY 1) e USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM seg WHERE section = 'awards' GROUP BY 1) a USING (doc_id) GROUP BY doc_id"""
    ),
    "s1_analysis_events": sql(
        """SELECT doc_id, i - 1 AS seq, e[i].kind AS kind, e[i].value AS value FROM (SELECT doc_id, unnest(range(1, len(e) + 1)) AS i, e FROM (SELECT doc_id, list_concat([{'kind': 'step', 'value': 'start'}], list_transform(list_filter(['basic_info', 'education', 'internship', 'projects', 'skills'], lambda s: NOT list_contains(sections, s)), lambda s: {'kind': 'miss', 'value': s}),
        list_transform(coalesce(hits, []), lambda t: {'kind': 'hit', 'value': t}), [{'kind': 'score', 'value': CAST(n_chars AS VARCHAR)}, {'kind': 'step', 'value': 'done'}]) AS e FROM documents JOIN found USING (doc_id) LEFT JOIN (SELECT doc_id, list_sort(list(DISTINCT term)) AS hits FROM skillhit GROUP BY 1) USING (doc_id)))"""
    ),
}
