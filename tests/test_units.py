"""Small cases whose results are known."""

import datetime
import time
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.functions import web as W
from dossier.functions.rules import LATIN, RuleSet
from dossier.operators import evaluate as E
from dossier.operators import jobs as J
from dossier.operators import lines as L
from dossier.operators import records as R
from dossier.operators import scoring as S
from dossier.operators import stats
from dossier.operators import terms as M
from dossier.plans import matching
from dossier.plans.views import Views
from dossier.sources import files as A
from dossier.streaming import streams


def one(df):
    return df.first()[0]


def test_word_bounds_and_aliases(spark):
    docs = spark.createDataFrame([(1, "uses JavaScript daily."), (2, "knows Java."), (3, "c++ and node.js, 3d"), (4, None), (5, "")], "doc_id long, text string")
    terms = spark.createDataFrame([("java",), ("c++",), ("3d",), ("javascript",), ("",)], "term string")
    hits = {(r.doc_id, r.term) for r in M.match_terms(docs, terms, {"js": "javascript"}).collect()}
    assert hits == {(1, "javascript"), (2, "java"), (3, "c++"), (3, "3d")}
    assert one(spark.range(1).select(T.contains_kw(F.lit("javascript"), "java"))) is False
    assert one(spark.range(1).select(T.contains_kw(F.lit("java."), "java"))) is True


def test_months_fifteen_and_brute_force(spark):
    rows = [(1, i, s, e) for i, (s, e) in enumerate([(0, 5), (3, 8), (9, 11), (20, 22)])] + [(2, 0, 5, 3)]
    got = {r.person_id: (r.months, r.spans) for r in S.merged_months(spark.createDataFrame(rows, "person_id long, seq long, start_m int, end_m int")).collect()}
    assert got == {1: (15, 2)}


def test_fusion_and_coverage(spark):
    assert one(spark.range(1).select(M.fuse(F.lit(80.0), F.lit(40.0), 0.65))) == 66
    students = spark.createDataFrame([(i, "c", "", "") for i in range(10)], "record_id long, class_name string, major string, grade string")
    issues = spark.createDataFrame([(i, "late work") for i in range(8)], "record_id long, issue string")
    assert stats.training_coverage(students, issues, "late", "c", ()).first().percent == 80.0


def test_batch_status(spark):
    items = [(1, "success"), (1, "success"), (1, "failed"), (2, "failed"), (2, "failed"), (3, "success"), (3, "skipped")]
    got = {r.batch_id: r.status for r in stats.batch_rollup(spark.createDataFrame(items, "batch_id long, status string")).collect()}
    assert got == {1: "partial_success", 2: "failed", 3: "success"}


def test_scope_of_guests(spark):
    rows = spark.createDataFrame([(1, 1, 5, "s"), (2, 1, 5, None)], "record_id long, organization_id long, user_id long, guest_session_id string")
    assert R.scope(rows, 1, is_guest=True).count() == 0
    assert [r.record_id for r in R.scope(rows, 1, is_guest=True, session_id="s").collect()] == [1]
    assert [r.record_id for r in R.scope(rows, 1, 5, strict_null=True).collect()] == [2]


def test_date_ranges(spark):
    cases = {"2020.03-2021.06": 16, "2019-2020": 24, "2024.06 - present": 3, "none": None, "2021.05-2020.01": None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.m for r in rows.select("s", T.date_range(F.col("s"), "2024-08-20")["months"].alias("m")).collect()} == cases


def test_redaction(spark):
    text = "mail a.b@x.org or (555) 123-4567, see https://x.org/a?b=1 and 10.0.0.1"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(T.redact(F.col("t")).alias("r")).collect()
    assert row[0].r.text == "mail [EMAIL] or [PHONE], see [URL] and [IP]" and row[0].r.counts["email"] == 1
    assert row[1].r.text == ""


def test_redaction_of_persons_and_bodies(spark):
    texts = [
        "张三\n手机：13800138000，+86 139-0013-9000\n求职意向：数据分析实习生\n某某大学 软件工程\n某科技有限公司 数据分析实习\n张三 QQ：12345678 微信: zs_2024 github.com/zhang",
        "教育背景\n人力资源管理\n专业技能\n沟通、组织、Office\n",
        "姓名：李娜\n现居地：北京市海淀区\n大学生活动中心大学 李娜娜 李娜",
        "", None, "No. 110101199003071234 \ufdd0x\ufdd1",
    ]
    rows = [r.r for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.redact(F.col("t")).alias("r")).collect()]
    assert rows[0].text == "[NAME]\n手机：[PHONE]，[PHONE]\n求职意向：数据分析实习生\n[SCHOOL] 软件工程\n[COMPANY] 数据分析实习\n[NAME] QQ：[QQ] 微信: [WECHAT] [ACCOUNT]"
    assert {k: n for k, n in rows[0].counts.items() if n} == {"mobile": 2, "account": 1, "qq": 1, "wechat": 1, "school": 1, "company": 1, "name": 2}
    assert rows[1].text == texts[1] and sum(rows[1].counts.values()) == 0
    assert rows[2].text == "姓名：[NAME]\n现居地：[ADDRESS]\n大学生活动中心大学 李娜娜 [NAME]" and rows[2].counts["school"] == 0
    assert rows[3].text == "" and rows[4].text == "" and rows[5].text == "No. [ID] \ufdd0x\ufdd1"


def test_contacts_and_name_hint(spark):
    texts = ["姓名：成娇\n手机 +86 138-0013-8000 微信：cj_99 QQ 1234567\n期望薪资：8-10k/月 现居地：上海", "简历\n成娇 | 女 | 本科", "人力资源管理\nmail a@b.org, (555) 123-4567", "", None]
    got = [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.contacts(F.col("t")).alias("c"), T.name_hint(F.col("t")).alias("name")).select("c.*", "name").collect()]
    assert got[0] == ("", "13800138000", "cj_99", "1234567", "8-10k/月", "上海", "成娇") and got[1][-1] == "成娇"
    assert got[2] == ("a@b.org", "(555) 123-4567", "", "", "", "", "") and got[3] == ("",) * 7 and got[4] == (None,) * 7


def test_hit_spans_merge(spark):
    docs = spark.createDataFrame([(1, "ababa xAB"), (2, None)], "doc_id long, text string")
    got = sorted((r.start, r.end) for r in M.hit_spans(docs, ["ab", "ba"]).collect())
    assert got == [(0, 5), (7, 9)]


def test_weights(spark):
    w = F.create_map(F.lit("job_match"), F.lit(3.0), F.lit("highlight_strength"), F.lit(1.0), F.lit("other"), F.lit(9.0))
    assert one(spark.range(1).select(S.normalise_weights(w))) == {"job_match": 0.75, "highlight_strength": 0.25}


def test_limiters_against_brute_force():
    random.seed(3)
    times = sorted(random.uniform(0, 50) for _ in range(200))
    allowed, _ = streams.sliding_log(3, 5.0)(times, [])
    log = []
    for t, ok in zip(times, allowed, strict=True):
        assert ok == (sum(t - x < 5.0 for x in log) < 3)
        if ok:
            log.append(t)
    whole, _ = streams.fixed_window(3, 5.0)(times, [])
    first, state = streams.fixed_window(3, 5.0)(times[:77], [])
    assert first + streams.fixed_window(3, 5.0)(times[77:], state)[0] == whole


def test_files(spark, tmp_path):
    for name, text in {"a.txt": "hello there", "~$b.txt": "x", ".c.txt": "x", "README.md": "x", "sub/d.md": "", "sub/f.md": " \n", "e.pdf": "x"}.items():
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: (r.suffix, r.text, r.warnings) for r in A.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert got == {"a.txt": (".txt", "hello there", []), "f.md": (".md", " \n", ["no_text"])}
    (tmp_path / "jobs.jsonl").write_text('{"id": "1", "must_skills": ["a"]}\n{broken\n{"id": "2"}\n')
    assert sorted(r.id for r in A.read_jobs(spark, str(tmp_path / "jobs.jsonl")).collect()) == ["1", "2"]
    (tmp_path / "cases.json").write_text(json.dumps({"version": 1, "cases": [{"id": "a", "text": "t"}, {"id": "b", "text": "u"}]}))
    assert sorted(r.id for r in A.read_cases(spark, str(tmp_path / "cases.json")).collect()) == ["a", "b"]
    pools = spark.createDataFrame([(1, "A"), (2, "B")], "doc_id long, pool string")
    A.write_pools(pools, str(tmp_path / "pools"))
    A.write_jsonl(pools, str(tmp_path / "json"))
    A.write_stats({"by_pool": pools}, str(tmp_path / "stats"))
    assert spark.read.parquet(str(tmp_path / "pools")).where("pool = 'B'").first().doc_id == 2
    assert spark.read.json(str(tmp_path / "json")).count() == 2 and spark.read.option("header", "true").csv(str(tmp_path / "stats/by_pool")).count() == 2
    pools.select(F.col("doc_id").alias("report_id")).write.parquet(str(tmp_path / "t" / "reports.parquet"))
    assert A.read_table(spark, str(tmp_path / "t"), "reports").where("format IS NULL").count() == 2


def test_rule_set_from_json(tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"headings": {"x": "skills"}, "line_classes": [["award", "prize"]], "stop_words": ["a"]}))
    rules = RuleSet.from_json(str(tmp_path / "r.json"))
    assert rules.headings == {"x": "skills"} and rules.line_classes == (("award", "prize"),) and rules.stop_words == ("a",) and rules.weights == LATIN.weights


def test_results_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    terms = spark.createDataFrame([("the",), ("onre",)], "term string")
    a = M.match_terms(docs.repartition(7), terms).collect()
    b = M.match_terms(docs.coalesce(1).orderBy(F.desc("doc_id")), terms).collect()
    assert sorted(a) == sorted(b)


def test_first_card_stays_below_the_minimum(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0.01), (1, 2, 1, 0.005), (2, 1, 3, 0.9), (2, 2, 0, 0.0)], "doc_id long, job_id long, hits int, score double")
    assert sorted((r.doc_id, r.job_id, r["rank"]) for r in J.rank_jobs(rows).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_whole_texts(spark):
    long = "<p>" + "filler " * 6000 + "PhD, knows spark</p>"
    row = spark.createDataFrame([(long,)], "html string").select(W.visible_text(F.col("html")).alias("t")).select("t", W.skill_mentions(F.col("t"), ("spark", "sql")).alias("s"), F.size(T.vector_tokens(F.col("t"), {"phd": "doctor"})).alias("n")).first()
    assert len(row.t) > 40_000 and row.s == ["spark"] and row.n == 6004
    assert one(spark.range(1).select(T.vector_tokens(F.lit("JS or py"), {"js": "javascript", "py": "python"}))) == ["js", "javascript", "or", "py", "python"]


def test_cosine_takes_the_greater_of_plain_and_expanded(spark):
    aliases = {"py": "python"}
    a, b = spark.createDataFrame([(1, "likes py2"), (2, "")], "doc_id long, text string"), spark.createDataFrame([(7, "python")], "item_id long, text string")
    tokens, more = T.vector_tokens(F.col("text"), aliases), T.absent_roots(F.col("text"), aliases)
    rows = M.tfidf_cosine(a, b, M.fit_idf(a).limit(0), tokens, tokens, "doc_id", "item_id", more, more).collect()
    assert [(r.doc_id, r.item_id, round(r.cosine, 6)) for r in rows] == [(1, 7, round(1 / math.sqrt(3), 6))]
    assert M.tfidf_cosine(a, b, M.fit_idf(a).limit(0), tokens, tokens, "doc_id", "item_id").count() == 0


def test_sections_against_a_fold(spark):
    random.seed(5)
    words = ("skills x", "an award", "manager of", "college y", "responsible", "plain", "more")
    rows = [(d, n, random.choice(words), random.choice(("basic_info", "skills", "projects", "summary"))) for d in range(60) for n in range(1, random.randint(2, 14))]
    got = {(r.doc_id, r.line_no): r.section for r in L.infer_sections(spark.createDataFrame(rows, "doc_id long, line_no int, line string, section string"), LATIN).collect()}
    kinds = {"skills x": "skills", "an award": "awards", "college y": "education"}
    want = {}
    for d in range(60):
        now, given, lines = "basic_info", "", [r for r in rows if r[0] == d]
        for _, n, line, section in lines:
            now = kinds.get(line, section if section != given else now)
            if line in ("manager of", "responsible") and now not in ("internship", "projects", "campus"):
                now = "internship"
            given = section
            want[d, n] = now
    assert got == want and len(got) == len(rows)


def test_latency_of_few_and_equal_values(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 2, 2, 9)] + [("b", 4.0), ("c", None)], "k string, v double")
    got = {r.k: (r.n, r["mean"], r.p50, r.p95, r.least, r.most) for r in stats.latency_summary(rows, "v", "k").collect()}
    assert got == {"a": (5, 3.2, 2.0, 9.0, 1.0, 9.0), "b": (1, 4.0, 4.0, 4.0, 4.0, 4.0)}


def test_redaction_report_counts_documents(spark):
    docs = spark.createDataFrame([(1, "a@b.org and c@d.org"), (2, None), (3, " "), (4, "plain")], "doc_id long, text string")
    got = {r.kind: (r.total, r.documents) for r in L.redaction_report(docs).collect()}
    assert got["email"] == (2, 1) and got["empty"] == (2, 2) and got["needs_review"] == (0, 0) and got["ip"] == (0, 0)


def test_pair_score_by_hand(spark):
    docs = spark.createDataFrame([(1, "java spark\nteam"), (2, "nothing")], "doc_id long, text string")
    job = spark.createDataFrame([(9, "java engineer", "cat", ["spark", "sql"], ["team"])], "job_id long, position string, category string, must array<string>, nice array<string>")
    lines = spark.createDataFrame([(1, 1, "java spark", "skills"), (1, 2, "team", "odd"), (1, 3, "x", "odder"), (1, 4, "x", "education")], "doc_id long, line_no int, line string, section string")
    hits = M.hit_sections(lines, J.job_terms(job).select("term"))
    rows = J.pair_score(docs, job, hits, lines.select("doc_id", "section")).collect()
    assert [(r.doc_id, r.job_id, r.hits, r.must, r.nice, round(r.position_share, 6)) for r in rows] == [(1, 9, 3, 0.5, 1.0, round(1 / 3, 6))]
    assert abs(rows[0].evidence - 2.5 / 3.3) < 1e-12  # skills and an unlisted one, of those and education: unlisted ones count once
    assert abs(rows[0].score - (0.8 * (0.275 + 0.2 + 0.25 / 3) + 0.2 * 2.5 / 3.3)) < 1e-12


def test_late_events_and_expired_limits(spark, tmp_path):
    """Files come one by one: an event of a day that was given as final in an earlier batch is not counted; a limiter's state survives batches and ends."""
    schema = "event_id long, user_id long, ts timestamp"
    at = lambda d, h=0, m=0: datetime.datetime(2024, 1, d, h, m)
    for n, rows in enumerate([[(1, 1, at(1)), (2, 1, at(1, 0, 1)), (3, 1, at(1, 0, 2))], [(4, 1, at(1, 0, 3)), (5, 2, at(8))], [(7, 1, at(8, 1))], [(6, 1, at(1, 5)), (8, 1, at(8, 1, 30)), (9, 3, at(20))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by age, in seconds
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    days = {str(r.day): r.n for r in streams.collected(streams.stream_daily_volume(stream())).collect()}
    assert days == {"2024-01-01": 4, "2024-01-08": 3}
    for limit in (streams.limit_fixed, streams.limit_sliding):
        got = {r.event_id: r.allowed for r in streams.collected(limit(stream(), "user_id", 3, 3600.0)).collect()}
        assert got == {1: True, 2: True, 3: True, 4: False, 5: True, 7: True, 8: True, 9: True}


def test_requirement_basis(spark):
    docs = spark.createDataFrame([(1, "java spark team"), (2, None)], "doc_id long, text string")
    job = spark.createDataFrame([(9, "java engineer", "cat", ["spark", "sql", "JavaScript"], ["team"]), (8, "cook", "kitchen", None, None)], "job_id long, position string, category string, must array<string>, nice array<string>")
    first = spark.createDataFrame([(1, 9), (2, 9), (1, 8)], "doc_id long, job_id long")
    got = sorted(tuple(r) for r in J.requirement_basis(first, docs, job).collect())
    assert got == [(1, 8, [], [], 0, 0), (1, 9, ["spark", "JavaScript"], ["sql"], 2, 1), (2, 9, [], ["spark", "sql", "JavaScript"], 0, 3)]


def test_request_adds_postings_without_a_hit(spark):
    """A posting whose terms hold a word of the request counts though the document has no hit in it; words match whole, in Han characters as parts."""
    jobs = spark.createDataFrame(
        [(1, "Java", "x", ["java", "spring"], []), (2, "JavaScript", "x", ["react"], []), (3, "Designer", "x", ["photoshop"], []), (4, "数据分析师", "x", ["excel"], ["java"])], "job_id long, position string, category string, must array<string>, nice array<string>"
    )
    docs = spark.createDataFrame([(1, "photoshop"), (2, "nothing"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, section string, term string")
    assert J.request_words("Java 数据 Java, a") == ["java", "数据"]
    pairs = J.pair_score(docs, jobs, none, none.select("doc_id", "section"), "Java 数据")
    got = {(r.doc_id, r.job_id): (r.hits, round(r.score, 6)) for r in J.with_context(pairs, docs, jobs, "Java 数据").collect()}
    assert got[1, 3] == (1, 0.3575) and {k for k in got if k[0] != 1} == {(d, j) for d in (2, 3) for j in (1, 4)}
    assert got[2, 4] == (0, round(0.2 * 2 / 2, 6)) and got[2, 1] == (0, round(0.2 * 1 / 2, 6))
    ranked = {(r.doc_id, r.rank): (r.job_id, r.hits) for r in J.rank_for_request(pairs, docs, jobs, "Java 数据", k=2).collect()}
    assert ranked == {(1, 1): (3, 1), (1, 2): (4, 0), (2, 1): (4, 0), (2, 2): (1, 0), (3, 1): (4, 0), (3, 2): (1, 0)}
    with pytest.raises(ValueError, match="over 1 postings"):
        J.with_context(pairs, docs, jobs, "Java 数据", most=1)
    assert J.with_context(pairs, docs, jobs, "?!").count() == pairs.count()


def test_bounds_before_sums(spark):
    """The same best postings as by all sums, from fewer pairs, where few postings share a document's weighty terms."""
    random.seed(11)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    pick = lambda n: random.choices(words, k=n)
    jobs = spark.createDataFrame([(j, " ".join(pick(2)), "", sorted(set(pick(6))), sorted(set(pick(3)))) for j in range(400)], "job_id long, position string, category string, must array<string>, nice array<string>")
    docs = spark.createDataFrame([(d, " ".join(pick(30))) for d in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    lines = docs.select("doc_id", F.lit("skills").alias("section"), F.col("text").alias("line"))
    hits = M.hit_sections(lines, J.job_terms(jobs).select("term"))
    sections = lines.select("doc_id", "section")
    pairs = J.pair_score(docs, jobs, hits, sections)
    rows = lambda df: sorted((r.doc_id, r.rank, r.job_id, r.hits, round(r.score, 9)) for r in df.collect())
    assert rows(J.top_jobs(docs, jobs, hits, sections)) == rows(J.rank_jobs(pairs))
    terms = J.posting_terms(jobs, "")
    few = J.candidates(J.held_terms(docs, terms.select("term"), hits, J.SECTION_NAMES), terms, sections, 5, 6).count()
    assert few < pairs.count()


def test_parts_by_grams(spark, monkeypatch):
    """Terms that are parts of texts, more than a scan takes as literals: found by one gram each, whatever their length; as by contains()."""
    random.seed(7)
    letters = "ab1-é数据"
    text = lambda n: "".join(random.choices(letters, k=n))
    docs = [(i % 50, text(random.randrange(80))) for i in range(90)] + [(60, None), (61, ""), (62, "X1-Y"), (None, "1-a1-b")]
    terms = {text(random.randrange(1, 7)) for _ in range(120)} | {"1", "x1-y", "1-a1-b1-1", "  ", "\\d"}
    df, lexicon = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    want = {(r.doc_id, r.term) for r in M.match_terms(df, lexicon, {"据1": "a1"}).collect()}
    monkeypatch.setattr(M, "SUBSTRING_TERMS", 0)
    got = [(r.doc_id, r.term) for r in M.match_terms(df, lexicon, {"据1": "a1"}).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 300
    plain = {(d, t) for d, x in docs for t in {t.strip().lower() for t in terms} if t and x and t in x.lower() and not re.fullmatch("[a-z+#.]{2,}", t) and t != "a1"}
    assert plain <= want


def test_pairs_of_a_task_do_not_grow(spark, small, monkeypatch):
    """The number of partitions in which documents meet the postings follows the number of pairs; rows are the same, also where hits repeat."""
    v = Views(spark, small)
    monkeypatch.setattr(J, "TASK_PAIRS", 100)
    n = v.documents.count() * v.v_job.count() // 100
    assert n > 8 and n <= J.pair_parts(v.documents, v.v_job) <= n + 1
    pairs = lambda hits: J.pair_score(v.documents, v.v_job, hits, matching.segmented(v).select("doc_id", "section"))
    rows = pairs(matching.section_hits(v))
    assert rows.rdd.getNumPartitions() in (n, n + 1)
    assert sorted(map(str, rows.collect())) == sorted(map(str, pairs(matching.section_hits(v).distinct()).collect()))
    features = J.rule_features(v.documents, v.v_job, matching.section_hits(v))
    assert features.rdd.getNumPartitions() in (n, n + 1)


def test_phrases_by_the_words_around_a_gap(spark, monkeypatch):
    """Names of two words are told from the words around a gap, without a second look at the texts; longer ones are verified; as by contains()."""
    random.seed(8)
    text = lambda n: "".join(random.choices(["a", "b", "é", "据", " ", "-", ". "], k=n))
    docs = [(i, text(random.randrange(60))) for i in range(80)] + [(90, None), (91, ""), (92, "BA b")]
    terms = {t for t in (text(random.randrange(3, 9)).strip() for _ in range(300)) if re.search(r"\w\W+\w", t)} | {"a b", "ba b", "(a b"}
    two = {t for t in terms if re.fullmatch(r"\w+[^\w]+\w+", t)}
    assert len(two) > 60 and len(terms - two) > 20
    want = lambda some: {(d, t) for d, x in docs for t in some if x and t in x.lower()}
    got = lambda some: sorted((r.doc_id, r.term) for r in M.match_terms(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in some], "term string")).collect())
    monkeypatch.setattr(M, "SUBSTRING_TERMS", 0)
    assert got(terms) == sorted(want(terms)) and len(want(terms)) > 60
    monkeypatch.setattr(M, "_verified", None)
    assert got(two) == sorted(want(two))


def test_snapshots_of_analyses(spark, tmp_path):
    """Micro-batches give what one batch of all rows gives; a repeated batch, and one that broke off before its list, change nothing; failures stay with their error, ended records as they are."""
    docs = spark.createDataFrame([(i, None if i == 3 else " " if i == 4 else f"the tools\nof school {i} " * (i + 1)) for i in range(40)], "doc_id long, text string")
    merge = streams.analysed_into(LATIN)
    kind = spark.createDataFrame([], "doc_id long, status string, error string, quality string").schema
    parts, whole = (streams.Snapshots(spark, f"{tmp_path}/{n}", kind, "doc_id", 8) for n in ("parts", "whole"))
    rows = lambda store, *a: sorted(tuple(r) for r in store.read(*a).collect())
    assert rows(parts) == []
    for number in range(3):
        parts.apply(docs.where(F.col("doc_id") % 3 == number), number, merge)
    whole.apply(docs, 0, merge)
    assert rows(parts) == rows(whole) and len(rows(parts)) == 40 and [r[1:3] for r in rows(parts)[3:5]] == [("failed", "no_source"), ("failed", "no_text")]
    before = rows(parts)
    parts.apply(docs.withColumn("text", F.lit("other")), 2, merge)
    (tmp_path / "parts/lists/batch=9").mkdir()
    assert rows(parts) == before and parts.batches() == [0, 1, 2]
    parts.apply(docs.where("doc_id < 2").unionByName(spark.createDataFrame([(99, "new")], docs.schema)), 9, merge)
    assert [r for r in rows(parts) if r[0] != 99] == before and len(rows(parts)) == 41 and rows(parts, 2) == before
    assert len(set(parts.holders(9).values())) > 1  # unchanged buckets stay with the batch that wrote them


def test_overdue_tasks_by_hand_moved_clock():
    p = "processing"
    state, done = streams.overdue(None, [(0.0, p, -1)], 75.0, 75, 2)
    assert (state, done) == ((p, 0.0, 0), [])
    state, done = streams.overdue(state, [], 75.1, 75, 2)
    assert (state, done) == (("pending", 75.1, 1), ["requeue"])
    state, done = streams.overdue(state, [], 500.0, 75, 2)
    assert done == []  # waits until it is processed again
    state, done = streams.overdue(state, [(600.0, p, -1), (700.0, p, -1)], 760.0, 75, 2)
    assert (state, done) == ((p, 700.0, 2), ["requeue"])
    state, done = streams.overdue(state, [], 800.0, 75, 2)
    assert (state, done) == (None, ["fail"])
    assert streams.overdue((p, 0.0, 0), [(10.0, "success", -1)], 900.0, 75, 2) == (None, [])


def test_tasks_share_a_state(spark, tmp_path):
    """One state for all tasks, over several micro-batches: each goes by its own rows and time; nulls keep what is known; what ended is forgotten."""
    p, at = "processing", lambda s: datetime.datetime(2024, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    batches = [[(1, p, 2, at(0)), (2, p, None, at(0)), (3, p, 0, at(50)), (4, p, 0, at(0)), (5, "success", 0, at(0))], [(4, "success", None, at(60)), (9, "success", 0, at(100))], [(2, p, None, at(150)), (9, "success", 0, at(160))], [(9, "success", 0, at(300))], [(9, "success", 0, at(301))]]
    schema = "task_id long, status string, requeues int, ts timestamp"
    for n, some in enumerate(batches):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        time.sleep(1.1)
    got = {}
    for buckets in (1, 3):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        got[buckets] = sorted((r.task_id, r.action) for r in streams.collected(streams.recover_stream(stream, late="0 seconds", buckets=buckets)).collect())
    assert got[1] == got[3] == [("1", "fail"), ("2", "requeue"), ("2", "requeue"), ("3", "requeue")]
    state, out = streams.overdue_tasks({"a": (p, 0.0, 0), "b": (p, 20.0, 0)}, {"c": [(500.0, p, 0)]}, 80.0, False, 75, 2)
    assert out == [("a", "requeue")] and state == {"a": ("pending", 80.0, 1), "b": (p, 20.0, 0), "c": (p, 500.0, 0)}


def test_recovery_stream_as_in_batch(spark, tmp_path):
    """By the events' time, which a last row moves on: the same actions as recover_stale over the table."""
    rows = [(i, ("processing", "success", "pending")[i % 3], i % 4, datetime.datetime(2024, 1, 1, 0, 0, i)) for i in range(50)]
    schema = "task_id long, status string, requeues int, ts timestamp"
    for n, some in enumerate((rows, [(1000, "success", 0, datetime.datetime(2024, 1, 1, 0, 1, 40))], [(1001, "success", 0, datetime.datetime(2024, 1, 1, 0, 1, 41))])):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {(int(r.task_id), r.action) for r in streams.collected(streams.recover_stream(stream, late="0 seconds")).collect()}
    tasks = spark.createDataFrame(rows, schema).withColumnRenamed("ts", "updated_at")
    want = {(r.task_id, r.action) for r in R.recover_stale(tasks, F.lit("2024-01-01 00:01:40").cast("timestamp")).where("action <> 'keep'").collect()}
    assert got == want and {a for _, a in got} == {"fail", "requeue"}


def test_evidence_zones_and_advice(spark):
    """Education, skills and awards are no zones; a title asks for detail; what is listed comes in order and once; a short duty stands in where nothing else does."""
    rules = RuleSet(
        line_classes=(("skills", "特长|熟练"), ("award", "荣获|被评为"), ("education", "就读于"), ("role_title", "任.*干事"), ("duty", "负责|协助")), actions="负责|协助", results="提升|增长", vague="较强|良好", courses="课程|实训", domains=("运营", "数据", "设计"),
    )
    rows = [
        (1, 1, "特长：播音主持、视频剪辑", "skills"), (1, 2, "2023年至今就读于海滨学院酒店管理专业", "education"), (1, 3, "2023年至今任海滨学院团委宣传部干事", "campus"), (1, 4, "荣获校园歌手大赛十佳歌手", "campus"), (1, 5, "本人综合素质良好，表达能力较强", "summary"),
        (2, 1, "负责活动现场的物料整理与执行工作", "internship"), (2, 2, "负责活动现场的物料整理与执行工作", "projects"), (2, 3, "协助运营，阅读量提升 30%，覆盖 2000 人", "internship"), (2, 4, "协助" * 60, "internship"), (2, 5, "主修课程：数据设计", "education"),
        (3, 1, "负责文案", "projects"), (3, 2, "协助完成文案工作", "projects"), (4, 1, "x", "basic_info"),
    ]
    got = {r.doc_id: r for r in L.evidence(spark.createDataFrame(rows, "doc_id long, line_no int, line string, section string"), rules).collect()}
    assert got[1].zones == ["title:3", "vague:5"] and got[1].duty_zones == 0 and got[1].missing == ["basic_info", "internship", "projects"] and (got[1].exp_lines, got[1].role_titles) == (1, 1)
    assert got[2].zones == ["weak:1"] and got[2].weak_lines == [1] and got[2].metric_lines == [3] and got[2].long_lines == [4] and got[2].course_lines == [5] and got[2].domain_words == ["运营", "数据", "设计"] and got[2].domain_lines == [3, 5]
    assert (got[2].exp_lines, got[2].metrics, got[2].results) == (3, 1, 1) and got[3].zones == ["short:2"] and got[3].exp_lines == 1 and got[4].zones == [] and got[4].confidence == 0.4
    scores = {f"s_{d}": 80.0 for d in S.DIMENSIONS}
    base = {"quality": "high", "weak_lines": [4, 9, 11], "metrics": 5, **scores}
    cases = [
        {"doc_id": 1, **base, "missing_keywords": ["a", "b", "c", "d"], "hit_keywords": ["e", "f", "g"]}, {"doc_id": 2, **base, "quality": "low", "missing_keywords": ["a"], "hit_keywords": []}, {"doc_id": 3, **base, "weak_lines": [], "missing_keywords": None, "hit_keywords": None},
        {"doc_id": 4, **base, "metrics": 1, "s_job_match": 41.5, "s_experience_match": 50.0, "missing_keywords": ["a", "a"], "hit_keywords": ["e", "f", "g"]},
    ]
    schema = "doc_id long, quality string, weak_lines array<int>, metrics long, " + ", ".join(f"s_{d} double" for d in S.DIMENSIONS) + ", missing_keywords array<string>, hit_keywords array<string>"
    items = {r.doc_id: ["|".join(i) for i in r.items] for r in S.advice_items(spark.createDataFrame([tuple(c[n.split()[0]] for n in schema.split(", ")) for c in cases], schema)).collect()}
    assert items[1] == ["no_result|4|tell_result", "no_result|9|tell_result", *(f"missing_keyword|{k}|use_keyword" for k in "abc"), "matched_keyword|e|move_forward"]
    assert items[2] == ["no_text||save_as_text"] and items[3] == ["complete||tune"]
    assert items[4] == ["no_result|4|tell_result", "no_result|9|tell_result", "missing_keyword|a|use_keyword", "matched_keyword|e|move_forward", "matched_keyword|f|move_forward", "few_metrics|1|add_metrics", "low_experience_match|4|fill_section"]


def test_ranges_of_heavy_tails(spark):
    """However values lie, most in a range are under three times the median; ranks and splits are those of a sort."""
    random.seed(9)
    values = sorted({round(random.paretovariate(0.3), 6) for _ in range(4000)} | {1e300, -5.0})
    rows = [(k, v) for k in ("a", "b") for v in values for _ in range(1 + (v < 2))] + [("c", None), ("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    in_ranges = stats.in_ranges(df.distinct(), "v", ["k"], buckets=32).groupBy("k", "bucket").count().collect()
    sizes = sorted(r["count"] for r in in_ranges if r.k == "a")
    assert len(sizes) > 24 and sizes[-1] < 3 * sizes[len(sizes) // 2]
    below = {(r.k, r.v): r.below for r in stats.counted_below(df, "v", ["k"], buckets=32).collect()}
    own = sorted(v for k, v in rows if k == "a")
    assert all(below["a", v] == own.index(v) for v in values[::50]) and below["c", None] == 0 and below["c", 1.0] == 1
    words = spark.createDataFrame([(f"g{i * 7919 % 1000:04d}",) for i in range(1000)] * 2, "g string")
    split = {r.g: r.split for r in E.group_split(words, "g").collect()}
    assert [split[f"g{i:04d}"] for i in range(1000)] == ["train"] * 650 + ["validation"] * 150 + ["test"] * 200
    assert E.group_split(words.limit(0), "g").count() == 0


def test_name_in_sections(spark):
    docs = spark.createDataFrame([(1, "x\n姓名：李娜\n王小明"), (2, "y"), (3, "y"), (4, "张三\ny"), (5, None), (6, "")], "doc_id long, text string")
    lines = spark.createDataFrame([(2, 20, "王小明", "basic_info"), (2, 3, "李四", "summary"), (3, 15, "姓名: 赵六", "summary"), (3, 9, "数据分析", "basic_info"), (3, 2, "孙七", "skills")], "doc_id long, line_no int, line string, section string")
    assert {r.doc_id: r.name for r in L.name_in_sections(docs, lines).collect()} == {1: "李娜", 2: "王小明", 3: "赵六", 4: "张三", 5: None, 6: ""}


def test_rule_sets_as_rows(spark, tmp_path):
    """Written, with other versions and kinds beside them, and read again; fields that a version lacks have their default."""
    from dataclasses import replace

    from dossier.functions.han import HAN
    from dossier.functions.rules import SectionRules, read_rules, rule_rows

    first = rule_rows(spark, LATIN, 1).where("field NOT IN ('alpha', 'domains')")
    rows = first.unionByName(rule_rows(spark, replace(LATIN, alpha=0.4, actions="x"), 2)).unionByName(rule_rows(spark, HAN, 7))
    rows.write.parquet(f"{tmp_path}/rules")
    rows = spark.read.parquet(f"{tmp_path}/rules")
    assert read_rules(rows, RuleSet) == replace(LATIN, alpha=0.4, actions="x") and read_rules(rows, RuleSet, 1) == replace(LATIN, domains=(), alpha=0.55)
    assert read_rules(rows, SectionRules) == HAN
    with pytest.raises(ValueError, match="version 3"):
        read_rules(rows, RuleSet, 3)
    with pytest.raises(ValueError, match="no SectionRules"):
        read_rules(rows.limit(0), SectionRules)
