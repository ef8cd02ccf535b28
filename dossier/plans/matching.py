"""Queries that hold documents against job postings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import DOMAIN_TERMS, LATIN, SECTION_WEIGHTS, SNIPPET_BONUS
from ..operators import jobs as J
from ..operators import lines as L
from ..operators import terms as M
from . import texts
from .texts import found, segmented
from .views import Views, duck

REQUEST = "the of cat-1"
EXPERIENCE = r"\b(ering|onre|project)\b"
LEXICON = ("onre", "thea", "tion")
EDGES = (("the", "onth"), ("ering", "thea"), ("cat", "the"), ("tool", "and"))
CATALOG = (("classic", "education", 200, 1.0), ("modern", "skills", 400, 0.5), ("project", "projects", 800, 0.8), ("fallback", "", 0, 0.0))


def section_hits(v: Views):
    return M.hit_sections(segmented(v), J.job_terms(v.v_job).select("term"), once=False)


def scored(v: Views, request: str = ""):
    return J.pair_score(v.documents, v.v_job, section_hits(v), segmented(v).select("doc_id", "section"), request)


def ranked(v: Views):
    return J.rank_jobs(scored(v))


def wanted(v: Views):
    k = F.col("job_id")
    return v.v_job.select(
        k.alias("want_id"), F.when(k % 3 == 0, k + 1).alias("job_id"), F.when(k % 3 == 1, F.concat(F.lit("https://jobs.example.org/"), (k + 2).cast("string"))).otherwise("").alias("source_url"), F.upper("position").alias("position")
    )


def requests(v: Views):
    return v.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "any").otherwise("").alias("request"))


def edges(v: Views):
    return v.spark.createDataFrame(EDGES, "parent string, child string")


def missing(v: Views):
    return v.documents.select("doc_id", F.posexplode(F.array(F.lit("spark"), F.lit("sql"), F.lit("onth"))).alias("rank", "term"))


def replacements(v: Views):
    first = v.v_line.where("line_no = 1").select("doc_id", F.concat(F.lit("  "), "line").alias("old"), F.concat(F.lit("new "), F.substring("line", 1, 10)).alias("new"))
    none = v.v_line.where("line_no = 2").select("doc_id", F.concat(F.lit("absent "), "line").alias("old"), F.lit("added").alias("new"))
    return first.unionByName(none)


def rewrites(v: Views, which: int):
    hints = v.documents.select("doc_id", F.explode(F.array(F.lit("the"), F.lit("spark"))).alias("hint"))
    return J.apply_rewrites(v.v_line, replacements(v), hints)[which]


def inputs(v: Views):
    return v.v_record.select(
        "record_id", F.concat(F.lit("profile-"), F.col("job_profile_id").cast("string")).alias("profile_name"), F.col("target_position").alias("asked_position"), F.when(F.col("record_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("wanted")).alias("asked_description"),
        F.when(F.col("record_id") % 6 == 0, "described").alias("profile_description"), F.when(F.col("target_source") == "manual", F.col("target_position")).alias("manual"), F.when(F.col("record_id") % 4 == 0, "found").otherwise("").alias("detected"),
        (F.col("record_id") % 8 != 0).alias("allow_detected"), F.when(F.col("record_id") % 10 == 0, "selected").alias("override"),
    )


def gate_rows(v: Views):
    return v.v_record.select("record_id", (F.col("record_id") % 5).alias("rank"), (F.col("record_id") % 4).alias("need"), F.when(F.col("record_id") % 3 == 0, F.col("total_score")).alias("semantic"), (F.col("total_score") / 2).alias("rule"))


TERMS = (*DOMAIN_TERMS, "of the", "ta te", "distributed data processing")


def asked():
    """Two of three postings with terms of trades, of which the table has none."""
    more = F.when(F.col("item_id") % 3 == 0, " 负责数据分析与用户增长，数据可视化").when(F.col("item_id") % 3 == 1, " distributed data processing").otherwise("")
    return F.concat("text", more)


QUERIES = {
    "b1_verified_jobs": lambda v: J.verified_jobs(v.v_job).select("job_id", "position", "source_url"),
    "b3_filter_jobs": lambda v: J.filter_jobs(v.v_job, "CITY-1", "", "").select("job_id", "verified_total", "filtered_total"),
    "b4_search_jobs": lambda v: J.search_jobs(v.v_job, category="cat-2", keyword="TH").select("job_id", "position"),
    "b5_find_job": lambda v: J.find_job(v.v_job, wanted(v)),
    "b9_public_jobs": lambda v: J.public_jobs(v.v_job).select("job_id", "position", "must_skills", "nice_skills"),
    "b10_resolve_inputs": lambda v: J.resolve_inputs(inputs(v)).select("record_id", "position", "description"),
    "b11_resolve_target": lambda v: J.resolve_target(inputs(v)).select("record_id", "target", "source"),
    "h11_clean_skills": lambda v: v.v_job.select("job_id", J.clean_skills(F.when(F.col("job_id") % 2 == 0, F.col("must")), J.derive_skills(F.col("description"), LEXICON)).alias("skills")),
    "h12_term_groups": lambda v: J.term_groups(v.v_job).select("job_id", "t_position", "t_must", "t_nice", "t_all"),
    "h12_job_text": lambda v: J.job_text(v.v_job),
    "c10_candidate_pairs": lambda v: J.candidate_pairs(v.documents, v.v_job),
    "h13_pair_score": lambda v: J.full_list(v.documents, v.v_job, section_hits(v), segmented(v).select("doc_id", "section"), REQUEST),
    "e1_rank_for_request": lambda v: J.rank_for_request(scored(v, REQUEST), v.documents, v.v_job, REQUEST).select("doc_id", "job_id", "rank", "hits", "score", "percent"),
    "e1_top_jobs": lambda v: J.top_jobs(v.documents, v.v_job, section_hits(v), segmented(v).select("doc_id", "section")).select("doc_id", "job_id", "rank", "hits", "score", "percent"),
    "e1_rank_jobs": lambda v: ranked(v).select("doc_id", "job_id", "rank", "hits", "score", "percent"),
    "h14_alignment": lambda v: J.alignment(ranked(v).select("doc_id", "job_id"), v.documents, v.v_job, LATIN.degrees, EXPERIENCE),
    "h22_job_words": lambda v: v.benchmark.select("item_id", J.job_words(asked(), LATIN.stop_words, TERMS).alias("w")).select("item_id", F.col("w.must").alias("words"), "w.nice"),
    "h22_pick_profile": lambda v: J.pick_profile(v.documents, v.v_job.select(F.col("category").alias("profile"), F.explode("must").alias("alias"))),
    "h23_rule_score": lambda v: J.rule_score(J.rule_features(v.documents, v.v_job, section_hits(v))).select("doc_id", "job_id", "hits", "must_hits", "strong_hits", "weak_only", "rule_score"),
    "h24_final_score": lambda v: gate_rows(v).withColumn("gate", J.degree_gate(gate_rows(v))).select("record_id", "gate", J.final_score(F.col("gate"), F.col("semantic"), F.col("rule")).alias("score")),
    "h25_coverage_breakdown": lambda v: found(v).select("doc_id", J.coverage_breakdown(F.col("core") / 5, F.least("metrics", F.lit(10)) / 10, F.col("sections")).alias("coverage")),
    "h26_select_job": lambda v: J.select_job(ranked(v), requests(v)),
    "h26_requirement_basis": lambda v: J.requirement_basis(ranked(v).where("rank = 1"), v.documents, v.v_job),
    "c11_skill_hints": lambda v: J.skill_hints(M.match_terms(v.documents, edges(v).select(F.explode(F.array("parent", "child")).alias("term"))), edges(v), missing(v)),
    "c12_apply_rewrites": lambda v: rewrites(v, 0),
    "c12_rewrite_log": lambda v: rewrites(v, 1).groupBy("doc_id", "change").agg(F.count("*").alias("n")),
    "c13_recommend_templates": lambda v: J.recommend_templates(found(v).select("doc_id", "sections", "size"), v.spark.createDataFrame(CATALOG, "template string, wants_section string, min_size int, base double")),
    "e10_evidence_snippets": lambda v: J.evidence_snippets(segmented(v), M.match_terms(v.documents, v.spark.createDataFrame([(t,) for t in ("onre", "thea", "anre")], "term string"))),
}

_GROUPS = r"""
SELECT *, list_concat(t_position, list_filter(list_concat(t_must, t_nice), lambda t: NOT list_contains(t_position, t)))[1:32] AS t_all
FROM (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS t_position, must AS t_must, nice AS t_nice FROM (SELECT *, regexp_extract_all(lower(position || ' ' || category), '[a-z][a-z0-9+#.-]+') AS l FROM v_job))"""
_TERMS = "SELECT job_id, term, CAST(list_contains(t_must, term) AS INT) AS is_must, CAST(list_contains(t_nice, term) AS INT) AS is_nice, CAST(list_contains(t_position, term) AS INT) AS is_position FROM (SELECT *, unnest(t_all) AS term FROM grouped)"
_WORDS = "SELECT DISTINCT doc_id, section, rtrim(unnest(regexp_extract_all(lower(line), '[a-z0-9+#.]+')), '.') AS term FROM seg"
_DOCWORDS = "SELECT DISTINCT doc_id, rtrim(unnest(regexp_extract_all(lower(text), '[a-z0-9+#.]+')), '.') AS term FROM documents"
_HIT = """
SELECT doc_id, t.* FROM docword JOIN jobterm t USING (term) WHERE regexp_matches(term, '^[a-z+#.]{2,}$')
UNION ALL SELECT doc_id, t.* FROM documents JOIN jobterm t ON NOT regexp_matches(term, '^[a-z+#.]{2,}$') AND contains(lower(text), term)"""
_SECHIT = """
SELECT DISTINCT doc_id, section, term FROM secword JOIN (SELECT DISTINCT term FROM jobterm) USING (term) WHERE regexp_matches(term, '^[a-z+#.]{2,}$')
UNION SELECT doc_id, section, term FROM seg JOIN (SELECT DISTINCT term FROM jobterm) t ON NOT regexp_matches(term, '^[a-z+#.]{2,}$') AND contains(lower(line), term)"""
_W = "CASE section " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in SECTION_WEIGHTS.items()) + " ELSE 1.0 END"
# words of letters as whole words, others as parts
_CONTEXT = r"len(list_filter(t_all, lambda t: regexp_matches(t, '(^|[^a-z0-9+#.])(the|of)[.]*([^a-z0-9+#.]|$)') OR contains(t, 'cat-1'))) / 3"
_COMPLETE = f"""
SELECT doc_id, job_id, hits, must, nice, position_share, evidence, context, 0.65 * r + 0.15 * evidence + 0.2 * context AS score FROM scored
UNION ALL
SELECT doc_id, job_id, 0, 0.0, 0.0, 0.0, 0.0, context, 0.2 * context FROM documents, (SELECT job_id, {_CONTEXT} AS context FROM grouped) g
WHERE context > 0 AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = documents.doc_id AND h.job_id = g.job_id)"""
_ASKED = """
SELECT *, least(greatest(score * 100, 0), 100) AS percent FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, hits DESC, job_id) AS rank FROM complete) WHERE rank <= 5 AND (score >= 0.08 OR rank = 1)"""
_SCORED = f"""
SELECT doc_id, job_id, hits, must, nice, position_share, evidence, context, r, len(t_position) AS np FROM (
  SELECT h.*, g.t_position, hit_must / greatest(len(t_must), 1) AS must, hit_nice / greatest(len(t_nice), 1) AS nice, hit_position / greatest(len(t_position), 1) AS position_share, coalesce(hit_weight / all_weight, 0.0) AS evidence,
    {_CONTEXT} AS context,
    0.55 * hit_must / greatest(len(t_must), 1) + 0.2 * hit_nice / greatest(len(t_nice), 1) + 0.25 * hit_position / greatest(len(t_position), 1) AS r
  FROM (SELECT doc_id, job_id, count(*) AS hits, sum(is_must) AS hit_must, sum(is_nice) AS hit_nice, sum(is_position) AS hit_position FROM hit GROUP BY ALL) h
  LEFT JOIN (SELECT doc_id, job_id, sum({_W}) AS hit_weight FROM (SELECT DISTINCT doc_id, job_id, section FROM hit JOIN sechit USING (doc_id, term)) GROUP BY ALL) w USING (doc_id, job_id)
  LEFT JOIN (SELECT doc_id, sum({_W}) AS all_weight FROM (SELECT DISTINCT doc_id, section FROM seg) GROUP BY 1) a USING (doc_id) JOIN grouped g USING (job_id))"""
_RANKED = """
SELECT *, least(greatest(score * 100, 0), 100) AS percent FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, hits DESC, job_id) AS rank FROM (SELECT *, 0.8 * r + 0.2 * evidence AS score FROM scored)) WHERE rank <= 5 AND (score >= 0.08 OR rank = 1)"""
_RULE = """
SELECT *, round(least(greatest(100.0 * hits / greatest(expected, 1), 30), 100)) AS s0 FROM (
  SELECT doc_id, job_id, count(*) AS hits, sum(is_must) AS must_hits, count(*) FILTER (list_has_any(coalesce(secs, []), ['skills', 'projects', 'internship'])) AS strong_hits,
    count(*) FILTER (len(coalesce(secs, [])) > 0 AND NOT list_has_any(secs, ['skills', 'projects', 'internship', 'campus'])) AS weak_only
  FROM hit LEFT JOIN (SELECT doc_id, term, list(DISTINCT section) AS secs FROM sechit GROUP BY ALL) USING (doc_id, term) WHERE is_must + is_nice > 0 GROUP BY ALL) JOIN (SELECT job_id, len(t_must) AS n_must, len(list_distinct(list_concat(t_must, t_nice))) AS expected, category = 'cat-1' AS has_profile FROM grouped) USING (job_id)"""
_RULE_STEPS = ("CASE WHEN must_hits > 0 THEN least(100, {0} + least(8, 2 * must_hits)) ELSE {0} END", "CASE WHEN n_must > must_hits THEN greatest(30, {0} - least(12, 3 * (n_must - must_hits))) ELSE {0} END", "CASE WHEN has_profile THEN least(100, {0} + 4) ELSE {0} END", "CASE WHEN strong_hits > 0 THEN least(100, {0} + least(6, strong_hits)) ELSE {0} END", "CASE WHEN weak_only > 0 AND weak_only >= greatest(1, hits // 2) THEN greatest(30, {0} - least(8, 2 * weak_only)) ELSE {0} END")
_RULE_SCORE = "SELECT *, s0 AS s FROM rulefeat"
for _step in _RULE_STEPS:
    _RULE_SCORE = f"SELECT * REPLACE ({_step.format('s')} AS s) FROM ({_RULE_SCORE})"
_BONUS = "CASE section " + " ".join(f"WHEN '{s}' THEN {b}" for s, b in SNIPPET_BONUS.items()) + " ELSE 0 END"
_RANK = "greatest(" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{texts._u(p)}') THEN {r} ELSE 0 END" for _, r, p in LATIN.degrees) + ")"
_NEED = "CASE education " + " ".join(f"WHEN '{n}' THEN {r}" for n, r, _ in LATIN.degrees) + " ELSE 0 END"
_EDGE = "SELECT * FROM (VALUES " + ", ".join(map(str, EDGES)) + ") e(parent, child)"
_INPUT = """
SELECT record_id, 'profile-' || job_profile_id AS profile_name, target_position AS asked_position, CASE WHEN record_id % 2 = 0 THEN ' ' ELSE 'wanted' END AS asked_description, CASE WHEN record_id % 6 = 0 THEN 'described' END AS profile_description,
  CASE WHEN target_source = 'manual' THEN target_position ELSE '' END AS manual, CASE WHEN record_id % 4 = 0 AND record_id % 8 <> 0 THEN 'found' ELSE '' END AS detected, CASE WHEN record_id % 10 = 0 THEN 'selected' END AS override FROM v_record"""
_REPLACED = """
SELECT doc_id, lower(trim(regexp_replace(old, '\\s+', ' ', 'g'))) AS key, min(new) AS new FROM (SELECT doc_id, '  ' || line AS old, 'new ' || substr(line, 1, 10) AS new FROM v_line WHERE line_no = 1
UNION ALL SELECT doc_id, 'absent ' || line, 'added' FROM v_line WHERE line_no = 2) GROUP BY ALL"""
_KEYED = "SELECT *, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS key FROM v_line"


def sql(text: str) -> str:
    return duck(
        text, seg=texts._SEG, lay=texts._LAY, pool=texts._POOL, wanted=texts._WANTED, found=texts._FOUND, grouped=_GROUPS, jobterm=_TERMS, secword=_WORDS, docword=_DOCWORDS, hit=_HIT, sechit=_SECHIT, scored=_SCORED, ranked=_RANKED, complete=_COMPLETE, asked=_ASKED, rulefeat=_RULE, edge=_EDGE, input=_INPUT,
        replaced=_REPLACED, keyed=_KEYED,
    )


_OK = "source_type = 'job_page' AND review_status IN ('single_source_verified', 'expert_reviewed') AND trim(position) <> ''"
SQL = {
    "b1_verified_jobs": sql(f"SELECT job_id, position, source_url FROM v_job WHERE {_OK}"),
    "b3_filter_jobs": sql(f"SELECT job_id, (SELECT count(*) FROM v_job WHERE {_OK}) AS verified_total, count(*) OVER () AS filtered_total FROM v_job WHERE {_OK} AND contains(lower(city), 'city-1')"),
    "b4_search_jobs": sql("SELECT job_id, position FROM v_job WHERE category = 'cat-2' AND contains(lower(position || ' ' || company || ' ' || category || ' ' || array_to_string(must, ' ')), 'th')"),
    "b5_find_job": sql(
        """SELECT want_id, arg_min(job_id, (p, job_id)) AS job_id FROM (SELECT w.job_id AS want_id, j.job_id, CASE WHEN (w.job_id % 3 = 0 AND j.job_id = w.job_id + 1) OR (w.job_id % 3 = 1 AND j.job_id = w.job_id + 2) THEN 0 ELSE 1 END AS p, w.position = j.position AS same
        FROM v_job w, v_job j) WHERE p = 0 OR same GROUP BY 1"""
    ),
    "b9_public_jobs": sql("SELECT job_id, position, must AS must_skills, nice AS nice_skills FROM v_job"),
    "b10_resolve_inputs": sql("SELECT record_id, coalesce(nullif(trim(profile_name), ''), nullif(trim(asked_position), ''), '') AS position, coalesce(nullif(trim(profile_description), ''), nullif(trim(asked_description), ''), '') AS description FROM input"),
    "b11_resolve_target": sql(
        "SELECT record_id, CASE WHEN manual <> '' THEN manual ELSE detected END AS target, CASE WHEN override IS NOT NULL THEN override WHEN manual <> '' THEN 'manual' WHEN detected <> '' THEN 'detected' ELSE 'generic' END AS source FROM input"
    ),
    "h11_clean_skills": sql("SELECT job_id, CASE WHEN job_id % 2 = 0 AND len(must) > 0 THEN must ELSE list_filter(['onre', 'thea', 'tion'], lambda t: contains(lower(description), t)) END AS skills FROM v_job"),
    "h12_term_groups": sql("SELECT job_id, t_position, t_must, t_nice, t_all FROM grouped"),
    "h12_job_text": sql(
        """SELECT job_id, array_to_string(list_filter(['category: ' || category, CASE WHEN education <> '' THEN 'education: ' || education END, CASE WHEN experience <> '' THEN 'experience: ' || experience END,
        CASE WHEN len(must) > 0 THEN 'must: ' || array_to_string(must, ', ') END, CASE WHEN len(nice) > 0 THEN 'nice: ' || array_to_string(nice, ', ') END], lambda x: x IS NOT NULL), chr(10)) AS text FROM v_job"""
    ),
    "c10_candidate_pairs": sql("SELECT doc_id, job_id, term, is_must, is_nice, is_position FROM hit"),
    "h13_pair_score": sql("SELECT * FROM complete"),
    "e1_rank_for_request": sql("SELECT doc_id, job_id, rank, hits, score, percent FROM asked"),
    "e1_top_jobs": sql("SELECT doc_id, job_id, rank, hits, score, percent FROM ranked"),
    "e1_rank_jobs": sql("SELECT doc_id, job_id, rank, hits, score, percent FROM ranked"),
    "h14_alignment": sql(
        f"""SELECT doc_id, job_id, CASE WHEN need = 0 THEN 'not_required' WHEN rank >= need THEN 'meets' ELSE 'unknown' END AS education, CASE WHEN NOT wants THEN 'not_required' WHEN shown THEN 'evidence_found' ELSE 'unknown' END AS experience
        FROM (SELECT doc_id, job_id FROM ranked) JOIN (SELECT doc_id, {_RANK} AS rank, regexp_matches(lower(text), '{texts._u(EXPERIENCE)}') AS shown FROM documents) USING (doc_id) JOIN (SELECT job_id, {_NEED} AS need, experience <> '' AS wants FROM v_job) USING (job_id)"""
    ),
    "h22_job_words": f"""SELECT item_id, list(DISTINCT w ORDER BY length(w) DESC, w)[1:18] AS words, any_value(nice) AS nice FROM (
        SELECT item_id, unnest(list_concat(regexp_extract_all(low, '[a-z][a-z0-9+#.]+'), list_filter([{", ".join(f"'{t}'" for t in TERMS if len(t) <= 16)}], lambda t: contains(low, t)))) AS w, list_filter([{", ".join(f"'{t}'" for t in sorted(TERMS) if len(t) > 16)}], lambda t: contains(low, t)) AS nice
        FROM (SELECT item_id, lower(text) || CASE item_id % 3 WHEN 0 THEN ' 负责数据分析与用户增长，数据可视化' WHEN 1 THEN ' distributed data processing' ELSE '' END AS low FROM benchmark))
        WHERE w NOT IN ({", ".join(f"'{s}'" for s in LATIN.stop_words)}) GROUP BY 1""",
    "h22_pick_profile": sql(
        "SELECT doc_id, arg_min(profile, (-n, profile)) AS profile FROM (SELECT doc_id, profile, sum(length(term)) AS n FROM docword JOIN (SELECT category AS profile, unnest(must) AS term FROM v_job) USING (term) GROUP BY ALL) GROUP BY 1"
    ),
    "h23_rule_score": sql(f"SELECT doc_id, job_id, hits, must_hits, strong_hits, weak_only, CASE WHEN expected = 0 THEN 50 ELSE s END AS rule_score FROM ({_RULE_SCORE})"),
    "h24_final_score": sql(
        "SELECT record_id, gate, CASE WHEN gate = 'fail' THEN 0 WHEN record_id % 3 = 0 THEN round(total_score) ELSE total_score / 2 END AS score FROM (SELECT *, CASE WHEN record_id % 4 = 0 OR record_id % 5 = 0 THEN 'unknown' WHEN record_id % 5 >= record_id % 4 THEN 'pass' ELSE 'fail' END AS gate FROM v_record)"
    ),
    "h25_coverage_breakdown": sql(
        """SELECT doc_id, 100 * (0.55 * core / 5 + 0.25 * least(metrics, 10) / 10 + 0.2 * (CAST(list_contains(sections, 'education') AS INT) + CAST(list_has_any(sections, ['internship', 'projects', 'campus']) AS INT) + CAST(list_contains(sections, 'skills') AS INT)
        + CAST(list_has_any(sections, ['summary', 'basic_info']) AS INT)) / 4) AS coverage FROM found"""
    ),
    "h26_select_job": sql(
        """SELECT doc_id, job_id, score, CASE WHEN doc_id % 3 <> 0 THEN 'recommended' WHEN score >= 0.22 THEN 'accepted' ELSE 'rejected' END AS decision, (position_share >= 0.5 AND must >= 0.34) OR (must >= 0.6 AND (hits >= 2 OR position_share > 0)) AS strong FROM ranked WHERE rank = 1"""
    ),
    "h26_requirement_basis": sql(
        """SELECT doc_id, job_id, hit[1:8] AS hit_skills, missing[1:8] AS missing_skills, len(hit) AS hit_count, len(missing) AS miss_count FROM (SELECT doc_id, job_id, list_filter(must, lambda s: is_hit(s)) AS hit, list_filter(must, lambda s: NOT is_hit(s)) AS missing
        FROM (SELECT r.doc_id, r.job_id, g.must, coalesce(held, []) AS held FROM ranked r JOIN grouped g USING (job_id) LEFT JOIN (SELECT doc_id, job_id, list(DISTINCT term) AS held FROM hit GROUP BY ALL) h ON h.doc_id = r.doc_id AND h.job_id = r.job_id WHERE rank = 1))""".replace("is_hit(s)", "len(list_filter(held, lambda t: contains(s, t) OR contains(t, s))) > 0")
    ),
    "c11_skill_hints": sql(
        """SELECT doc_id, hint, reason, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, rank, hint) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, hint ORDER BY kind) AS first FROM (
          SELECT DISTINCT doc_id, parent AS hint, 'skill_graph' AS reason, 0 AS kind, 0 AS rank FROM docword w JOIN edge ON term = child WHERE NOT EXISTS (SELECT 1 FROM docword x WHERE x.doc_id = w.doc_id AND x.term = parent)
          UNION ALL SELECT doc_id, hint, 'missing', 1, rank FROM documents, (VALUES ('spark', 0), ('sql', 1), ('onth', 2)) m(hint, rank))) WHERE first = 1) WHERE place <= 5"""
    ),
    "c12_apply_rewrites": sql("SELECT doc_id, line_no, coalesce(new, line) AS line FROM keyed LEFT JOIN replaced USING (doc_id, key)"),
    "c12_rewrite_log": sql(
        """SELECT doc_id, change, count(*) AS n FROM (SELECT doc_id, 'rewrite' AS change FROM keyed JOIN replaced USING (doc_id, key) UNION ALL SELECT doc_id, 'append_rewrite' FROM replaced r WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE k.doc_id = r.doc_id AND k.key = r.key)
        UNION ALL SELECT doc_id, 'skill_graph' FROM documents d, (VALUES ('the'), ('spark')) h(hint) WHERE NOT EXISTS (SELECT 1 FROM v_line l WHERE l.doc_id = d.doc_id AND list_contains(regexp_extract_all(lower(line), '[a-z0-9+#.]+'), hint))) GROUP BY ALL"""
    ),
    "c13_recommend_templates": sql(
        "SELECT doc_id, template, score, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS place FROM (SELECT doc_id, template, CAST(base + CASE WHEN list_contains(sections, wants) THEN 2 ELSE 0 END + CASE WHEN size >= least_size THEN 1 ELSE -1 END AS DOUBLE) AS score FROM found, (VALUES "
        + ", ".join(map(str, CATALOG)) + ") c(template, wants, least_size, base))) WHERE place <= 3"
    ),
    "e10_evidence_snippets": sql(
        f"""SELECT doc_id, line_no, section, score, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS place, max(score) OVER (PARTITION BY doc_id) AS best FROM (
        SELECT doc_id, line_no, section, CAST(CASE WHEN n > 0 THEN 2 * n + least(length(trim(line)) / 40, 2) + {_BONUS} + 0.3 ELSE 0 END AS DOUBLE) AS score FROM (SELECT *, len(list_intersect(list_transform(regexp_extract_all(lower(line), '[a-z0-9+#.]+'), lambda w: rtrim(w, '.')), ['onre', 'thea', 'anre'])) AS n FROM seg
        WHERE length(trim(line)) >= 8 AND NOT regexp_matches(line, '^\\s*[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\s*$')))) WHERE place <= 6 AND (score > 0 OR best = 0)"""
    ),
}
