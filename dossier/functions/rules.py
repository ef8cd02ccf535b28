"""U1. Rule sets: what the operators look for, as data. A set can be read from JSON; LATIN is for texts in Latin script."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of sections, other names for them, their weights and bonuses, and which are core and which experience.
SECTIONS = ("basic_info", "summary", "education", "internship", "projects", "campus", "skills", "awards")
SECTION_ALIASES = {
    "experience": "internship", "work": "internship", "work_experience": "internship", "employment": "internship", "job": "internship",
    "certificate": "awards", "certificates": "awards", "honor": "awards", "honors": "awards", "profile": "basic_info", "contact": "basic_info",
    "education_background": "education", "project": "projects", "skill": "skills", "campus_experience": "campus",
}
SECTION_WEIGHTS = {"skills": 1.5, "projects": 1.35, "internship": 1.35, "experience": 1.25, "education": 0.8}
#: All of these names.
SECTION_NAMES = (*SECTIONS, *(n for n in SECTION_WEIGHTS if n not in SECTIONS))
SNIPPET_BONUS = {"skills": 1.2, "projects": 1.1, "internship": 1.1, "campus": 0.6, "summary": 0.3, "education": 0.2, "basic_info": -0.4}
CORE_SECTIONS = ("basic_info", "education", "internship", "projects", "skills")
EXPERIENCE_SECTIONS = ("internship", "projects", "campus")
#: Words of Han characters that are no names of persons, words that name subjects, and parts of bodies and roles.
NOT_NAMES = (
    "教育背景", "实习经历", "工作经历", "项目经历", "专业技能", "自我评价", "求职意向", "基本信息", "个人信息", "联系方式", "获奖情况", "校园经历", "社会实践", "主修课程",
    "数据分析", "数据挖掘", "数据运营", "软件工程", "计算机", "人工智能", "深度学习", "机器学习", "前端开发", "后端开发", "全栈开发", "产品经理", "产品设计", "视觉设计", "平面设计",
    "新媒体", "内容运营", "用户运营", "活动运营", "人力资源", "电子商务", "市场营销", "财务管理", "会计学", "法学", "英语", "日语",
    "本科", "专科", "硕士", "博士", "研究生", "应届生", "在校生", "实习生", "负责人", "工程师", "设计师", "分析师", "运营官", "程序员", "开发者",
    "团队协作", "沟通能力", "学习能力", "抗压能力", "责任心", "吃苦耐劳", "乐观开朗", "认真负责", "工作认真",
    "熟悉", "掌握", "了解", "负责", "参与", "完成", "协助", "优化", "维护", "设计", "开发", "测试", "部署",
    "简历", "个人", "目前", "现居", "期望", "意向", "目标", "岗位", "职位", "公司", "集团", "有限", "股份",
    "北京", "上海", "广州", "深圳", "杭州", "成都", "武汉", "西安", "南京", "苏州", "天津", "重庆", "长沙", "郑州", "青岛", "大连", "厦门", "合肥", "福州", "济南",
    "哈尔滨", "沈阳", "昆明", "南昌", "石家庄", "太原", "南宁", "贵阳", "海口", "兰州", "银川", "西宁", "呼和浩特", "乌鲁木齐", "拉萨",
)
MAJOR_HINT = (
    "管理|工程|科学|技术|经济|法学|医学|文学|理学|工学|农学|艺术|计算机|软件|电子|机械|土木|新闻|广告|设计|英语|数学|物理|化学|生物|护理|教育|营销|贸易|物流|"
    "心理|统计|通信|自动化|建筑|环境|材料|食品|药学|会计|金融|人力|数据|智能|媒体|传播|编辑|财务|网络|信息|国际|商务|公共"
)
NOT_A_NAME = "大学|学院|公司|集团|专业|实习|经理|工程师|设计|开发|分析|运营"
#: Terms of trades, which postings in Han characters are searched for.
DOMAIN_TERMS = (
    "数据分析", "数据运营", "商业分析", "数据清洗", "数据可视化", "可视化", "机器学习", "深度学习",
    "用户增长", "内容运营", "内容策划", "新媒体运营", "账号运营", "社群运营", "活动策划", "网络推广",
    "品牌营销", "数字营销", "搜索引擎优化", "项目管理", "产品设计", "交互设计", "视觉设计", "平面设计",
    "需求分析", "竞品分析", "用户研究", "原型设计", "接口开发", "系统开发", "前端开发", "后端开发",
    "数据库", "数据建模", "自动化测试", "性能优化", "风险控制", "客户服务", "供应链管理", "电商运营",
    "短视频运营", "视频剪辑", "文案策划", "拍摄剪辑", "直播运营", "用户画像", "指标体系", "报表开发",
)
#: Weights of the six score dimensions.
DIMENSIONS = ("content_completeness", "experience_match", "language_professionalism", "format_standardization", "highlight_strength", "job_match")
DEFAULT_WEIGHTS = {"content_completeness": 0.20, "experience_match": 0.20, "language_professionalism": 0.15, "format_standardization": 0.10, "highlight_strength": 0.15, "job_match": 0.20}


@dataclass(frozen=True)
class RuleSet:
    """Headings by word, other names of terms, ordered line classes and degrees (name, rank, pattern), words of actions, results and vagueness, and skill terms."""

    headings: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    line_classes: tuple[tuple[str, str], ...] = ()
    degrees: tuple[tuple[str, int, str], ...] = ()
    above: str = "(or above|and above|or higher|preferred)"
    actions: str = ""
    results: str = ""
    vague: str = ""
    skills: tuple[str, ...] = ()
    stop_words: tuple[str, ...] = ()
    courses: str = ""
    domains: tuple[str, ...] = ()
    alpha: float = 0.55
    weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))

    @classmethod
    def from_json(cls, path: str) -> RuleSet:
        with open(path) as file:
            given = json.load(file)
        as_tuples = lambda x: tuple(map(tuple, x)) if x and isinstance(x[0], list) else tuple(x)
        return cls(**{f.name: as_tuples(given[f.name]) if isinstance(given[f.name], list) else given[f.name] for f in fields(cls) if f.name in given})


@dataclass(frozen=True)
class Move:
    """H35. Lines of `sources` (the earlier first) for which the clause holds go to `target`: all of them, or the first; as copies; if the target is empty, if the
    document shows a heading (or none) of a section, if a line of a section holds a clause (or none does); or those around the headings of a section."""

    sources: tuple[str, ...]
    clause: str
    target: str
    first: bool = False
    copy: bool = False
    if_empty: bool = False
    heading: str = ""
    no_heading: str = ""
    held: tuple[str, str, bool] | None = None
    around: str = ""
    also: str = ""
    stops: str = ""


@dataclass(frozen=True)
class SectionRules:
    """U1, H35. What tells the sections of a document's lines, as data.

    headings by text and what words in them say otherwise; signals (patterns, of a line or of one without blanks) and sizes; predicates, each true where one of its clauses is: names that hold, those
    after ! that may not; which section a line opens and whether the document goes over to it, by the section and whether a heading was seen; where a line
    belongs that stands in a section; moves. Of each the first that applies counts; a target = is the line's own section.
    """

    headings: dict[str, str]
    signals: dict[str, str]
    predicates: dict[str, tuple[str, ...]]
    opens: tuple[tuple[tuple[str, ...] | None, str, str], ...]
    switches: tuple[tuple[tuple[str, ...] | None, tuple[str, ...] | None, bool | None, str, bool], ...]
    refine: tuple[tuple[tuple[str, ...] | None, str, str], ...] = ()
    moves: tuple[Move, ...] = ()
    resolve: tuple[tuple[str, str, str], ...] = ()
    anywhere: tuple[str, ...] = ()
    no_field: str = ""
    inline: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    compact: tuple[str, ...] = ()
    sizes: dict[str, tuple[bool, int | None, int | None]] = field(default_factory=dict)
    empty: dict[str, str] = field(default_factory=dict)
    fragments: tuple[tuple[str, str, str, str], ...] = ()
    makes_room: tuple[str, ...] = ()
    #: A pattern without which a line can meet none of these signals, which are then not looked for.
    guard: tuple[str, tuple[str, ...]] = ("", ())
    #: Parts, in lower case, one of which stands in each line that meets the signal without meeting the guard's pattern; none if there is no such line. A part between slashes is a
    #: pattern, without regard to case.
    hints: dict[str, tuple[str, ...]] = field(default_factory=dict)


#: Rows that a rule set is read from at most.
MOST_FIELDS = 1000


def rule_rows(spark: SparkSession, rules: RuleSet | SectionRules, version: int) -> DataFrame:
    """U1. A rule set as rows (version, kind, field, value as JSON), to be kept beside others."""
    return spark.createDataFrame([(version, type(rules).__name__, name, json.dumps(value, ensure_ascii=False)) for name, value in asdict(rules).items()], "version int, kind string, field string, value string")


def read_rules(rows: DataFrame, kind: type, version: int | None = None) -> RuleSet | SectionRules:
    """U1. The rule set of a version, the last one unless told, from rows of rule_rows(); fields without a row have their default. Other kinds' rows may stand beside it."""
    own = rows.where(F.col("kind") == kind.__name__)
    version = own.agg(F.max("version")).first()[0] if version is None else version
    found = own.where(F.col("version") == version).limit(MOST_FIELDS + 1).collect() if version is not None else []
    if not found or len(found) > MOST_FIELDS:
        raise ValueError(f"no {kind.__name__} of version {version}" if not found else f"over {MOST_FIELDS} fields")
    known = {f.name for f in fields(kind)}
    given = {r.field: _frozen(json.loads(r.value)) for r in found if r.field in known}
    if kind is SectionRules and "moves" in given:
        given["moves"] = tuple(Move(**m) for m in given["moves"])
    return kind(**given)


def _frozen(value):
    """Lists as tuples, at any depth."""
    if isinstance(value, list):
        return tuple(map(_frozen, value))
    return {k: _frozen(v) for k, v in value.items()} if isinstance(value, dict) else value


LATIN = RuleSet(
    headings={"the": "skills", "of": "education", "on": "internship", "was": "summary", "and": "projects", "that": "campus", "in": "awards", "de": "education", "le": "skills", "der": "projects", "la": "internship"},
    aliases={"py": "python", "js": "javascript", "with": "the", "from": "that"},
    line_classes=(
        ("skills", r"^(skills?|tools?|the)\b"), ("award", r"\b(award|prize|honou?r|anly)\b"), ("role_title", r"\b(engineer|manager|intern|eron)\b"),
        ("education", r"\b(university|college|school|anes)\b"), ("duty", r"\b(responsible|assist|erin|helped|onin)\b"),
    ),
    degrees=(("college", 1, r"\b(college|associate|the)\b"), ("bachelor", 2, r"\b(bachelor|undergraduate|and)\b"), ("master", 3, r"\b(master|graduate|with)\b"), ("doctor", 4, r"\b(doctor|phd|was)\b")),
    actions=r"\b(built|led|designed|ering|onre)\b", results=r"\b(improved|reduced|increased|tion|inti)\b", vague=r"\b(various|some|many|etc|ou|ha)\b",
    skills=("python", "sql", "spark", "excel", "the", "tion", "ering"),
    stop_words=("the", "and", "of", "to", "in", "that", "was", "is", "de", "la", "le"),
    courses=r"\b(courses?|training|modules?|thaton)\b", domains=("spark", "analytics", "marketing", "erent", "tionth", "schichte"),
)
