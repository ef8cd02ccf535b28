"""Plans and rows of what must not grow faster than the input."""

import re

from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.functions import web as W
from dossier.functions.han import HAN
from dossier.functions.rules import LATIN
from dossier.operators import jobs as J
from dossier.operators import lines as L
from dossier.operators import scoring, sections as S
from dossier.operators import terms as M
from dossier.plans import matching, registry, texts
from dossier.plans.views import Views


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def exchanges(df) -> list[str]:
    return [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]


def test_pages_are_cleaned_once_for_degrees_and_skills(spark, small):
    for name in ("h9_infer_degree", "h10_skill_mentions"):
        assert optimized(registry.queries()[name](spark, small)).count("&nbsp;") == 1, name


def test_degrees_of_odd_pages(spark):
    html = [None, "", "<p>Master</p>", "<p>the college or above, PhD</p>", "bachelor preferred; master"]
    rows = spark.createDataFrame(list(enumerate(html)), "i int, html string").select("i", W.infer_degree(W.visible_text(F.col("html")), LATIN.degrees, LATIN.above).alias("d")).orderBy("i").collect()
    assert [tuple(r.d) for r in rows] == [(0, 0), (0, 0), (3, 3), (1, 4), (2, 3)]


def test_bounds_leave_hits_where_they_are(spark, small):
    moved = exchanges(registry.queries()["e1_top_jobs"](spark, small))
    assert moved and not any(re.search(r"doc_id\S*, (term|job_id)|job_id", line) for line in moved)
    df = registry.queries()["e1_top_jobs"](spark, small)
    df.collect()
    assert plan(df).split("Initial Plan")[0].count("ReusedExchange") > 0  # hits meet once


def test_full_list_makes_pairs_once(spark, small):
    v = Views(spark, small)
    sections = matching.segmented(v).select("doc_id", "section")
    df = registry.queries()["h13_pair_score"](spark, small)
    assert sum("REPARTITION_BY_NUM" in line for line in exchanges(df)) == 1
    assert not any("job_id" in line for line in exchanges(df))
    for request in (matching.REQUEST, "?!"):
        old = J.with_context(J.pair_score(v.documents, v.v_job, matching.section_hits(v), sections, request), v.documents, v.v_job, request)
        key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
        assert key(J.full_list(v.documents, v.v_job, matching.section_hits(v), sections, request)) == key(old)


def test_vectors_stay_with_their_texts(spark, small):
    for name in ("h20_tfidf_cosine", "h20_cosine_join"):
        df = registry.queries()[name](spark, small)
        assert not any(re.search(r"(doc_id\S*, term)|(doc_id\S*, item_id)|(item_id\S*, doc_id)|(item_id\S*, term)", line) for line in exchanges(df)), name


def test_cosines_are_the_same_where_nothing_is_broadcast(spark, small, monkeypatch):
    rows = lambda: sorted((r.doc_id, r.item_id, round(r.cosine, 9)) for r in texts.cosines(Views(spark, small), 0.3).collect())
    sent = rows()
    monkeypatch.setattr(M, "BROADCAST_TERMS", 0)
    assert sent and rows() == sent


def test_words_of_han_characters_are_looked_for_where_there_is_one(spark):
    assert S.parted("(?i)@|邮箱|Wechat|1[3-9]|(?:今|至今)|一等奖") == ("(?i)邮箱|一等奖", "(?i)@|Wechat|1[3-9]|(?:今|至今)")
    lines = spark.createDataFrame([(1, n, x) for n, x in enumerate(("my mail @ home", "邮箱 here", "nothing at all", "公司", "a" * 50 + " 项目：x"))], "doc_id bigint, line_no int, line string")
    rows = S.signals(lines.withColumn("section_heading", F.lit(None).cast("string")), HAN).orderBy("line_no").collect()
    assert [(r.contact, r.held, r.deliverable) for r in rows] == [(True, False, False), (True, False, False), (False, False, False), (False, True, False), (False, False, True)]
    ends = spark.createDataFrame([("【 教育背景 】\t",), ("：： 三、Skills ：|",), ("- a - ",), ("]】",)], "s string").select(S.clean_heading(F.col("s")).alias("c")).collect()
    assert [r.c for r in ends] == ["教育背景", "三、Skills", "a", ""]


def test_lists_of_words_are_looked_for_by_their_parts(spark, small):
    assert T.word_parts(r"\b(honou?r|tools?)\b") == (False, ("hono", "tool")) and T.word_parts(r"^(skills?|the)\b") == (True, ("skill", "the"))
    assert all(T.word_parts(p)[1] == () for p in (r"\b(a?|b)\b", r"\b(a|)\b", r"\b(a.c)\b", r"a|b", r"\b(19|20)[0-9]{2}\b", ""))
    lines = [None, "", "honor", "xhonor", "the honours", "my honour.", "tool", "tools up", "atool", "skill", "skillset", "skills: a", " skills", "the", "then", "hon", "x the"]
    rows = spark.createDataFrame([(x,) for x in lines], "s string")
    for p in (r"\b(honou?r|tools?)\b", r"^(skills?|the)\b", r"\b(a?|b)\b", r"tool"):
        assert rows.where(~T.meets(F.col("s"), p).eqNullSafe(F.col("s").rlike(p))).count() == 0, p
    assert "Contains(low" in optimized(registry.queries()["h17_evidence"](spark, small))


def test_whatever_is_a_metric_may_be_one(spark):
    lines = ["3%", "3 %", "3.5 +", "12k", "12 k", "7k9", "1 2 3", "123", "a1b22", "9 k", "k 9", "%5", "0.5k x", "10  %", "5+", "2019", ""]
    rows = spark.createDataFrame([(x,) for x in lines], "s string")
    assert rows.where(F.col("s").rlike(L.METRIC) & ~F.col("s").rlike(L.MAYBE_METRIC)).count() == 0


def test_few_words_are_looked_for_in_the_texts(spark, small, monkeypatch):
    texts_ = [None, "", "etc. the", "The.. end", "then .the", "c++ x", "the+ c++", "a.b the.", "xthe", "py thes", "python", "THE"]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    terms = spark.createDataFrame([(t,) for t in ("the", "c++", "etc.", "python", "The ", "", "a.b")], "term string")
    rows = lambda: sorted(map(tuple, M.match_terms(docs, terms, {"py": "python"}).collect()))
    few = rows()
    assert "Generate explode(array_distinct(transform(regexp_extract_all" not in optimized(registry.queries()["c11_skill_hints"](spark, small))
    monkeypatch.setattr(M, "WORD_TERMS", 0)
    assert few == rows() == [(2, "the"), (3, "the"), (5, "c++"), (6, "c++"), (7, "a.b"), (7, "the"), (9, "python"), (10, "python"), (11, "the")]


def test_hints_take_one_pass_over_the_hits(spark, small):
    hits = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "p"), (2, "a"), (3, "x"), (None, "a"), (None, "p")], "doc_id long, term string")
    edges = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "b"), ("a", "b"), ("p", "a")], "parent string, child string")
    missing = spark.createDataFrame([(1, "q", 0), (1, "z", 1), (2, "p", 0), (4, "p", 2), (4, "p", 1)], "doc_id long, term string, rank int")
    got = [tuple(r) for r in J.skill_hints(hits, edges, missing, 3).orderBy("doc_id", "place").collect()]
    assert got == [(None, "p", "skill_graph", 1), (1, "p", "skill_graph", 1), (1, "q", "skill_graph", 2), (1, "z", "missing", 3), (2, "p", "missing", 1), (4, "p", "missing", 1), (4, "p", "missing", 2)]
    assert J.skill_hints(hits, edges, missing, 2).where("doc_id = 1").count() == 2
    moved = exchanges(registry.queries()["c11_skill_hints"](spark, small))
    assert not any(re.search(r"hint", line) for line in moved), moved


def test_lines_stay_with_their_document_for_snippets(spark, small):
    lines = [(1, 1, "onre stands here", "skills"), (1, 2, "no term stands here", "skills"), (1, 3, "a b and onre, c d e", "x"), (2, 1, "onre stands here", "x"), (2, 2, "short", "x"), (3, 1, "fonre is no word, c d is", "x")]
    section_lines = spark.createDataFrame(lines, "doc_id long, line_no int, line string, section string")
    hits = spark.createDataFrame([(1, "onre"), (1, "c d"), (1, " X"), (3, "onre"), (3, "c d")], "doc_id long, term string")
    got = {(r.doc_id, r.line_no): round(r.score, 3) for r in J.evidence_snippets(section_lines, hits).collect()}
    assert got == {(1, 1): 3.9, (1, 3): 4.775, (2, 1): 0.0, (3, 1): 2.9}
    df = registry.queries()["e10_evidence_snippets"](spark, small)
    assert not any("line_no" in line for line in exchanges(df))


def test_profiles_move_lines_once(spark, small):
    df = registry.queries()["d22_profile_stats"](spark, small)
    df.collect()
    assert "ReusedExchange" in plan(df).split("Initial Plan")[0]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    skills = frame([(1, "implicit", 0.72), (1, "lexicon", 0.9), (2, "lexicon", 0.9), (None, "implicit", 0.72)], "doc_id long, source string, confidence double")
    education, awards = frame([(1,), (1,), (3,), (None,)], "doc_id long"), frame([(2,), (3,)], "doc_id long")
    got = scoring.profile_stats(skills, education, awards, frame([(1, 24), (2, None), (3, 1)], "doc_id long, months long")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(None, 1, 1, 0.72, 0, 0, 0, 0.0), (1, 2, 1, 0.81, 2, 0, 24, 2.0), (2, 1, 0, 0.9, 0, 1, 0, 0.0)]


def test_personal_data_is_looked_for_where_it_may_be(spark, small):
    cases = [
        None, "", "12345678901234567X", "123456789012345678", "13800138000", "+86 139-0013-9000", "139\t0013 9000", "(555)1234567", "(55) 123-4567", "(555)-1234-4567", "+1 (555) 123-4567", "555 123 4567", "555-12345678", "5551234567", "a@b.cc", "a@b", "https://x.y", "1.2.3.4",
        "1.2.3", "12.345.6.7", "123456789012", "12345678901", "1234567890123456789012", "a  b", "a\tb", "a\t\tb", "a\n\n\n\nb", "a\n\nb", " \t", "x 010 1234 5678 y", "李娜 (010) 1234-5678", "111 222-3333\n\n\n1.1.1.1  z@z.z",
    ]
    rows = spark.createDataFrame([(x,) for x in cases], "s string")
    mobile = rf"(?<![0-9]){T.MOBILE}(?![0-9])"
    for kind, pattern in [(k, p) for k, p, _ in T.PII] + [("mobile", mobile)]:
        lost = rows.where(F.col("s").rlike(pattern) & ~T._maybe(F.col("s"), *T.MAYBE[kind]))
        assert lost.count() == 0 and rows.where(F.col("s").rlike(pattern)).count() > 0, kind
    kinds = rows.select("s", T.residual_pii(F.col("s")).alias("k"), F.array_compact(F.array(*(F.when(F.col("s").rlike(p), F.lit(k)) for k, p, _ in T.PII))).alias("all"), T.redact(F.col("s"))["text"].alias("t"), T._squeezed(T.redact(F.col("s"))["text"]).alias("u"))
    assert kinds.where("NOT k <=> all OR NOT t <=> u").count() == 0
    assert optimized(registry.queries()["h6_residual_pii"](spark, small)).count("Contains(") == 2


def test_partitions_of_spans_follow_the_texts(spark, small, monkeypatch):
    docs = spark.createDataFrame([(n, x) for n, x in enumerate([None, "", "tion the thea", "none", "THE the" * 9])], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, M.hit_spans(docs, texts.SPAN_TERMS).collect()))
    parts = lambda: re.findall(r"Exchange hashpartitioning\(doc_id\S*, (\d+)\), REPARTITION_BY_NUM", plan(M.hit_spans(docs, texts.SPAN_TERMS)))
    few = rows()
    assert few[:3] == [(2, 0, 4), (2, 5, 8), (2, 9, 13)] and parts() == [str(spark.sparkContext.defaultParallelism)]
    monkeypatch.setattr(M, "TASK_CHARS", 4)
    assert parts() == [str(-(-(13 + 4 + 63) // 4))] and rows() == few


def test_lines_that_say_nothing_skip_the_rules(spark, small):
    """Lines of other scripts meet no table of rules; whatever meets a signal is hinted at; documents are sorted few times and copies of lines sort nothing."""
    texts_ = ["the word of it", "plain prose, with commas, and more.", "3", "", "maps", "PS: x", "ups ae", "QQ", "at 19xx", "my App", "WECHAT", "a·b", "x：y", "x: y", "、", "a、b、c", "Internship", "backend", "FRONTEND", "uSkills", "gpa", "Excel", "12)", "- 4.", "公司", "技能", "ひら", "über, pr", "13900001111"]
    lines = spark.createDataFrame([(1, n, x) for n, x in enumerate(texts_)], "doc_id bigint, line_no int, line string")
    headed = S.with_heading(lines, HAN)
    facts = S.Facts(HAN)
    got = {r.line: r for r in S.said(headed, HAN, facts).collect()}
    assert {x for x in texts_ if not got[x].told} == {"", "plain prose, with commas, and more.", "maps", "ひら"}
    full = S.signals(headed, HAN).selectExpr("line", *(f"{S.named(sql, {n: n for n in [*HAN.signals, *HAN.sizes, *HAN.predicates, 'heading']})} AS {name}" for name, sql in (("map", S.step(HAN)), ("refined", S.refinement(HAN)), ("facts", facts.sql(S.wording)))))
    for r in full.collect():
        assert (r.map, r.refined, r.facts) == (got[r.line].map, got[r.line].refined, got[r.line].facts), r.line
    looked = [F.expr(f"{name} <=> ({'tight' if name in HAN.compact else 'line'} RLIKE r'{pattern}')").alias(name) for name, pattern in HAN.signals.items() if name not in HAN.guard[1]]
    for r in S.signals(headed, HAN).select("line", *looked).collect():
        assert all(r[1:]), r
    df = registry.queries()["h35_place_lines"](spark, small)
    assert plan(df).count("Sort [") <= 5
