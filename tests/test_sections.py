"""H35: cases of documents in Han characters, and the rule tables against a plain reading of them, line by line."""

import random
import re

import pytest

from dossier.functions.han import HAN
from dossier.functions.rules import SECTIONS
from dossier.operators import lines as L
from dossier.operators import sections as S
from dossier.plans.views import Views

#: text, and parts of lines with the sections that they are in, and sections that stay empty.
CASES = (
    ("林小雨\n手机：13900001111\n求职意向：平面设计\n\n教育背景\n2018.09-2022.06 海滨大学 视觉传达 本科\n\n实习经历\n2021.07-2021.12 晨光传媒公司 设计助理\n负责海报与封面设计，完成 20+ 套物料\n\n项目经历\n2022.01-2022.05 宣传短片剪辑项目\n\n专业技能\nPhotoshop、Premiere", {"13900001111": "basic_info", "海滨大学": "education", "封面设计": "internship", "短片": "projects", "Photoshop": "skills"}, ("awards",)),
    ("个人信息 | 姓名 | 林小雨 | 电话 | 13900001111\n教育背景\n海滨大学 本科", {"姓名：林小雨": "basic_info", "电话：13900001111": "basic_info", "海滨大学": "education"}, ()),
    ("教育背景\n人力资源管理\n实习经历\n人事助理：筛选简历、安排面试。\n技能\n沟通、组织、Excel", {"人力资源管理": "education", "筛选简历": "internship", "Excel": "skills"}, ("summary",)),
    ("教育背景\t海滨大学 本科 统计学\n技能 | Python | SQL", {"海滨大学": "education", "Python": "skills", "SQL": "skills"}, ()),
    ("基本信息\n王五\n2019-2023 海滨大学 软件工程 本科\n专业技能\nPython", {"王五": "basic_info", "海滨大学": "education", "Python": "skills"}, ()),
    ("实习经历\n2022.07-2022.12 晨光科技公司 运营助理\n负责使用 Excel 与 Python 整理数据，协助完成周报\n专业技能\nPython、Excel", {"整理数据": "internship", "Python、Excel": "skills"}, ()),
    ("李晓\n星海网络公司\n实习 负责线上图片处理等工作 协助完成物料设计与优化 北岭职业技术学院\n专科 获得校园摄影大赛二等奖 专业技能 办公软件：熟练使用 Word / Excel，掌握办公自动化 自我评价 为人踏实，具备良好的沟通协调与团队协作能力。", {"图片处理": "internship", "北岭职业技术学院": "education", "办公软件": "skills", "二等奖": "awards", "为人踏实": "summary"}, ()),
    ("校内外经历\n学生会宣传部干事，负责推文排版\n职业技能\n熟练使用 Excel、Canva\n证书荣誉\n校级优秀学生干部", {"学生会": "campus", "Canva": "skills", "优秀学生": "awards"}, ()),
    ("专业技能\nPhotoshop、剪映\n个人荣誉：英语初级 计算机初级", {"Photoshop": "skills", "英语初级": "awards"}, ()),
    ("项目经历\n校园二手交易数据分析：完成指标统计。\n毕业设计：校园跑腿小程序原型。", {"二手交易": "projects", "跑腿小程序": "projects"}, ("campus",)),
    ("Education\nB.S. Mathematics\nInternship\nBackend intern: Flask and MySQL.\nSkills\nPython, Docker", {"Mathematics": "education", "Backend intern": "internship", "Docker": "skills"}, ()),
    ("本人性格开朗，学习能力强。\n熟悉 Word、Excel，会一点 PS。\n希望从事运营相关工作。", {"Word": "skills", "性格开朗": "summary"}, ("internship",)),
    ("赵六 / 数据分析\n教育背景\n信息管理与信息系统\n项目经历\nSales dashboard", {"信息管理": "education", "dashboard": "projects", "赵六": "basic_info"}, ()),
    ("实习经历\n学生会宣传部干事，负责公众号推文排版与活动拍摄\n证书：普通话二级、英语四级", {"学生会": "campus"}, ("projects", "awards")),
    ("教育背景\n海滨大学 计算机专业 本科\n主修课程：程序设计、数据库系统\n自我评价\n性格踏实，期待在专业平台获得成长，具备良好的沟通能力。", {"期待": "summary", "主修课程": "education"}, ("projects",)),
    ("技能证书\n视频剪辑：熟练使用 PR、AE，擅长字幕与成片输出。\n自我评价\n学习能力强，责任心强。", {"视频剪辑": "skills"}, ("internship",)),
    ("教育背景\n海滨大学 本科\n学业成绩：专业前10%，多次获得学校奖学金\n项目/课堂实践经历\n课程项目：公众号模拟运营\n荣誉：无", {"奖学金": "education", "课程项目": "projects"}, ("awards", "internship")),
    ("教育背景\n海滨大学 软件技术 专科\n本人学习能力强，具备良好的沟通协调与团队协作能力，做事踏实细致。\n自我评价", {"学习能力强": "summary"}, ()),
    ("自我评价\n具备扎实的专业知识，熟练掌握核心技能。工作严谨细致、共情力强，善于沟通协调。", {"共情": "summary"}, ()),
    ("工作经验\n1、2023年12月担任景区讲解员。\n2、2022至今，某校24班团支书。\n自我评价\n本人综合素养良好，沟通能力出色。", {"讲解员": "campus", "团支书": "campus", "综合素养": "summary"}, ("internship",)),
    ("教育背景\n海滨大学 人工智能专业 硕士\n学业表现：GPA 3.8/5.0，排名前5%，连续三年获得校级一等奖学金\n技能\nPython、SQL", {"GPA": "education"}, ("awards",)),
    ("教育背景\n海滨大学 护理学 本科\n校园经历\n参与组织护理技能大赛、文化节等活动4场", {"技能大赛": "campus"}, ("awards",)),
    ("项目经历\n数据分析项目：清洗数据并输出报告\n数据分析项目：清洗数据并输出报告", {"清洗数据": "projects"}, ()),
)


def as_lines(spark, texts):
    return spark.createDataFrame([(d, i + 1, line) for d, text in enumerate(texts) for i, line in enumerate(text.split("\n"))], "doc_id long, line_no int, line string")


def test_cases(spark):
    got = {}
    for r in S.place_lines(as_lines(spark, [c[0] for c in CASES]), HAN).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.line))
    for d, (text, wanted, empty) in enumerate(CASES):
        for part, section in wanted.items():
            assert any(s == section and part in line for s, line in got[d]), (text, part, got[d])
        assert not any(s in empty for s, _ in got[d]), (text, got[d])
        assert not any(line in ("教育背景", "实习经历", "Skills") for _, line in got[d])
    assert len(got[len(CASES) - 1]) == 1


class Plain:
    """A reading of the rule tables line by line, with a loop over each document."""

    def __init__(self, rules):
        self.rules = rules
        # \Q..\E and \x{....} are Java's
        self.signals = {n: re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), p)) for n, p in rules.signals.items()}

    def facts(self, line, head):
        rules, tight = self.rules, re.sub(r"\s+", "", line)
        out = {n: bool(p.search(tight if n in rules.compact else line)) for n, p in self.signals.items()} | {"heading": head is not None}
        for n, (compact, least, most) in rules.sizes.items():
            size = len(tight if compact else line)
            out[n] = (least is None or size >= least) and (most is None or size <= most)
        for n, clauses in rules.predicates.items():
            out[n] = any(self.holds(c, out) for c in clauses)
        return out

    @staticmethod
    def holds(clause, facts):
        return all(not facts[t[1:]] if t[0] == "!" else facts[t] for t in clause.split())

    def fold(self, rows):
        """rows: line_no, line, heading of it or None; yields (section, facts, line_no, line, heading)."""
        section, seen = "basic_info", False
        for no, line, head in rows:
            facts = self.facts(line, head)
            if head:
                section, seen = head, True
            else:
                target = next((t for froms, c, t in self.rules.opens if (froms is None or section in froms) and self.holds(c, facts)), "=")
                if target not in ("=", section) and next((v for f, to, s, c, v in self.rules.switches if (f is None or section in f) and (to is None or target in to) and s in (None, seen) and self.holds(c, facts)), False):
                    section = target
            yield [section, facts, no, line, head]

    @staticmethod
    def distinct(rows):
        seen, out = set(), []
        for r in sorted(rows, key=lambda r: r[2]):
            key = (r[0], re.sub(r"\s+", "", re.sub("[：:；;，,。．.、|｜]+", " ", r[3])).lower())
            if key[1] and key not in seen:
                seen.add(key)
                out.append(r)
        return out

    def place(self, lines, pure):
        rules = self.rules
        every = list(self.fold(lines))
        heads = {r[4] for r in every if r[4]}
        rows = self.distinct([r for r in every if not (r[4] and (pure(r[3], r[4]) or self.holds(rules.empty.get(r[4], "heading !heading"), r[1])))])
        for r in rows:
            target = next((t for froms, c, t in rules.refine if (froms is None or r[0] in froms) and self.holds(c, r[1])), "=")
            r[0] = r[0] if target == "=" else target
        for k, move in enumerate(rules.moves):
            if k == 2:
                rows = self.fragments(rows)
            near = self.near(every, move) if move.around else None
            fits = [r for r in rows if r[0] in move.sources and r[0] != move.target and (r[2] in near if move.around else self.holds(move.clause, r[1]))]
            if move.held and any(r[0] == move.held[0] and self.holds(move.held[1], r[1]) for r in rows) != move.held[2]:
                continue
            if (move.heading and move.heading not in heads) or (move.no_heading and move.no_heading in heads) or (move.if_empty and any(r[0] == move.target for r in rows)):
                continue
            if move.first and fits:
                fits = [min(fits, key=lambda r, m=move: (m.sources.index(r[0]), r[2]))]
            for r in fits:
                if move.copy:
                    rows.append([move.target, *r[1:]])
                else:
                    r[0] = move.target
        return sorted((r[2], r[0], r[3]) for r in self.distinct(rows))

    def fragments(self, rows):
        new = []
        for source, clause, pattern, target in self.rules.fragments:
            pattern = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), pattern)
            for r in rows:
                if r[0] == source and self.holds(clause, r[1]) and (m := re.search(pattern, r[3])) and m[1].strip(" "):
                    new.append([target, r[1], r[2], m[1].strip(" "), r[4]])
        targets = {f[3] for f in self.rules.fragments}
        return [r for r in rows if not (new and r[0] in targets and any(self.holds(c, r[1]) for c in self.rules.makes_room))] + new

    def near(self, every, move):
        found = set()
        for i, row in enumerate(every):
            if row[4] != move.around:
                continue
            some = False
            for r in reversed(every[max(0, i - 7) : i]):
                takes = self.holds(move.clause, r[1])
                if r[4] not in (None, move.around) or (some and not takes):
                    break
                if takes:
                    found.add(r[2])
                    some = True
            for r in every[i + 1 : i + 8]:
                takes = self.holds(move.clause, r[1]) or self.holds(move.also, r[1])
                if r[4] not in (None, move.around) or (not takes and self.holds(move.stops, r[1])):
                    break
                if takes:
                    found.add(r[2])
        return found


def check(spark, lines):
    """Against the plain reading of the same expanded lines and headings."""
    rows = S.with_heading(S.expand_lines(lines, HAN), HAN, "h").collect()
    clean = {r.line: r.clean for r in rows}
    pure = lambda line, head: clean[line] == "" or HAN.headings.get(clean[line]) == head
    got, want = {}, {}
    for r in S.place_lines(lines, HAN).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.section, r.line))
    for d in {r.doc_id for r in rows}:
        want[d] = Plain(HAN).place(sorted((r.line_no, r.line, r.h) for r in rows if r.doc_id == d), pure)
    assert {d: sorted(v) for d, v in got.items()} == {d: v for d, v in want.items() if v}
    return got


def test_as_a_plain_reading_of_the_tables(spark, small):
    """Lines of all cases and headings, dealt anew at random; and whole documents of the given tables with lines added before them."""
    random.seed(3)
    pool = sorted({line for text, _, _ in CASES for line in text.split("\n") if line} | {"实习经历", "教育背景", "自我评价", "技能", "获奖情况", "校园经历", "项目经验", "x", "主修课程：统计", "热爱生活，责任心强，团队协作能力好，做事踏实细心"})
    texts = ["\n".join(random.choices(pool, k=random.randint(1, 25))) for _ in range(150)]
    got = check(spark, as_lines(spark, texts))
    assert {s for rows in got.values() for _, s, _ in rows} == set(SECTIONS)
    check(spark, L.lines_of(Views(spark, small).v_resume.where("doc_id < 40")))


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 700])
def test_maps_compose_in_order(spark, n):
    """A long document's state after each line is that of the loop, wherever the maps are cut."""
    random.seed(n)
    maps = ["".join(random.choice(S.LETTERS) if random.random() < 0.3 else c for c in S.LETTERS) for _ in range(n)]
    rows = spark.createDataFrame([(1, i * 3, m) for i, m in enumerate(maps)] + [(2, 0, maps[0])], "doc_id long, line_no int, map string")
    got = {(r.doc_id, r.line_no): r.map[0] for r in S.composed(rows, n).collect()}
    state = S.LETTERS[0]
    for i, m in enumerate(maps):
        state = m[S.LETTERS.index(state)]
        assert got[1, i * 3] == state
    assert got[2, 0] == maps[0][0]


def test_edges(spark):
    """No lines; blank and null lines; lines without any section's words; a very long line."""
    none = as_lines(spark, ["x"]).limit(0)
    assert S.place_lines(none, HAN).count() == 0
    odd = spark.createDataFrame([(1, 1, None), (1, 2, "  "), (1, 3, "。"), (2, 1, "lorem " * 20_000), (None, 1, "技能"), (None, 2, "Python")], "doc_id long, line_no int, line string")
    assert sorted((str(r.doc_id), r.section) for r in S.place_lines(odd, HAN).collect()) == [("2", "basic_info"), ("None", "skills")]


def test_unknown_names_are_told(spark):
    from dataclasses import replace

    with pytest.raises(ValueError, match="odd"):
        S.signals(as_lines(spark, ["x"]).withColumn("section_heading", S.F.lit(None).cast("string")), replace(HAN, predicates={"odd": ("nothing_known",)}))
