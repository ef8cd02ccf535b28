"""U1, H35. The rule set for documents in Han characters: headings, signals of a line, and what they say about its section, as data."""

from __future__ import annotations

from .rules import SECTIONS, Move, SectionRules

#: What headings are called, by section.
HEADINGS = {
    "basic_info": ("个人信息", "基本信息", "联系方式", "联系信息", "个人资料", "基本资料", "求职意向", "目标岗位", "意向岗位", "应聘岗位", "期望岗位", "求职方向", "职业目标", "personal information", "contact", "profile"),
    "education": ("教育背景", "教育经历", "教育信息", "学习经历", "学历背景", "学习背景", "主修课程", "所学课程", "专业课程", "education", "education background"),
    "internship": (
        "实习", "工作", "实习经历", "工作经历", "工作经验", "就业经历", "工作实践", "岗位实践", "实践经历", "社会实践", "校外实践", "任职经历", "职业经历", "工作/实习经历", "实习/工作经历", "工作实习经历", "实习与工作",
        "work experience", "experience", "employment", "internship",
    ),
    "projects": (
        "项目经历", "项目经验", "项目作品", "作品经历", "项目/实训经历", "项目实训经历", "实训项目", "实训经历", "科研经历", "课程项目", "课程设计", "项目实践", "个人作品", "设计作品", "作品集", "作品展示", "项目一", "项目二", "项目三",
        "projects", "project experience", "portfolio",
    ),
    "campus": ("校园经历", "校园实践", "校内外经历", "校内外实践", "校内实践", "社团经历", "社会活动", "志愿经历", "学生工作", "在校经历", "学生干部", "campus", "activities"),
    "skills": (
        "专业技能", "职业技能", "技能", "技能清单", "技能证书", "技能特长", "技能专长", "个人技能", "技术技能", "计算机技能", "核心技能", "语言能力", "软件技能", "办公技能", "办公软件", "设计软件", "证书技能", "掌握软件", "软件掌握", "工具技能",
        "skills", "technical skills", "certificates",
    ),
    "awards": ("个人荣誉", "所获荣誉", "荣誉", "证书", "获奖经历", "荣誉证书", "荣誉奖项", "获奖情况", "奖项证书", "获奖证书", "奖学金", "证书与荣誉", "证书荣誉", "资格证书", "资质证书", "awards", "honors", "certifications"),
    "summary": ("自我评价", "自我介绍", "个人总结", "个人评价", "个人优势", "个人简介", "性格特点", "简介", "关于我", "summary", "objective", "about me"),
}
#: Headings that may stand within a line, and labels whose value may stand on the next line.
INLINE = (
    "个人信息", "基本信息", "联系方式", "求职意向", "目标岗位", "教育背景", "教育经历", "实习经历", "工作经历", "实习", "工作", "项目经历", "项目经验", "项目作品", "校园经历", "校内外经历", "社会实践", "专业技能", "职业技能", "办公软件", "设计剪辑",
    "个人荣誉", "荣誉证书", "证书荣誉", "获奖情况", "自我评价", "个人评价",
)
LABELS = (
    "姓名", "求职意向", "意向岗位", "目标岗位", "应聘岗位", "应聘职位", "期望岗位", "期望职位", "求职方向", "电话", "手机", "联系方式", "邮箱", "微信", "wechat", "qq", "现居", "现居地", "居住地", "所在地", "期望薪资", "薪资", "年龄", "学历", "政治面貌",
    "民族", "籍贯", "身高", "体重",
)
_MAJOR = (
    "管理|工程|科学|技术|经济|法学|医学|文学|理学|工学|农学|艺术|资源|人力|会计|金融|计算机|软件|电子|机械|土木|新闻|广告|设计|英语|日语|数学|物理|化学|生物|护理|教育|师范|营销|贸易|物流|心理|统计|通信|自动化|建筑|环境|材料|食品|药学|临床|"
    "政治|历史|哲学|社会|公共|商务|国际|信息|网络|数据|智能|媒体|传播|编辑|财务|本科|硕士|博士|专科|大专|学士|研究生|主修|专业"
)
_HAN = r"\x{4e00}-\x{9fa5}"
#: Patterns that a line is searched for.
SIGNALS = {
    "contact": r"(?i)@|邮箱|电话|手机|联系方式|微信|Wechat|QQ|现居|现居地|居住地|所在地|期望薪资|薪资|1[3-9]\d{9}",
    "date": r"(?i)(?:20\d{2}|19\d{2}|20xx|19xx)[./年-]?\s*(?:0?[1-9]|1[0-2])?\s*(?:-|至|~|—|–|到)\s*(?:20\d{2}|19\d{2}|20xx|19xx|今|现在|至今|present)",
    "school": "大学|学院|学校|本科|专科|大专|硕士|研究生|博士|专业|主修|课程",
    "org": "公司|集团|工作室|中心|传媒|科技|岗位|职位|实习|助理|运营|销售|客服|教师|设计师",
    "project_word": "项目|实训|课题|系统|平台|小程序|网站|账号|视频号|公众号|社群|作品|案例|短片|海报|片头|包装|拍摄|毕业设计",
    "skill_word": r"(?i)技能|证书|熟练|掌握|了解|英语|普通话|Office|Excel|Word|PPT|WPS|Python|SQL|Vue|React|剪映|Canva|秀米|Photoshop|Premiere|HarmonyOS|办公软件|办公自动化|设计剪辑|(?<![A-Za-z])(?:PS|PR|AE)(?![A-Za-z])",
    "award_word": "(?i)获奖|荣誉|奖学金|Uskills|优秀学生|一等奖|二等奖|三等奖|提名|大赛",
    "award_context": "个人荣誉|荣誉证书|证书荣誉|获奖情况|获奖证书",
    "honor_heading": "个人荣誉|荣誉证书|证书荣誉|获奖情况",
    "certificate": "证书|资格证|等级证|英语四级|英语六级|普通话|初级|中级|高级",
    "summary_heading": "自我评价|个人评价|自我介绍|个人总结|性格特点|个人优势|个人简介|关于我",
    "soft": "为人|性格|沟通|协调|团队协作|学习能力|学习力|执行力|抗压|适应|乐观|踏实|责任心|团队意识|共情|细心|严谨|亲和|积极主动|吃苦耐劳",
    "prose_start": r"^[-–—•·\s]*(?:本人|具备|热爱|擅长|性格|为人|做事|工作严谨|拥有|秉持|期待|希望以)",
    "action": "负责|参与|协助|配合|完成|执行|制作|处理|运营|维护|撰写|剪辑|设计|拍摄|策划|发布|管理|优化",
    "campus_org": "学生会|社团|班委|团委|志愿者|干部|干事|部长|主席|协会|实验室助手",
    "campus_context": "校园|学校|大学期间|在校期间|校内|校外实践|社会实践",
    "product": "(?i)小程序|平台|系统|网站|毕业设计|课题|实训|项目|App|数据分析",
    "major": _MAJOR,
    "intent_word": r"求职意向|意向岗位|目标岗位|应聘岗位|期望岗位|求职方向|期望职位|应聘职位\s*[:：\s]",
    "hope": "(?:希望|期望|意向).{0,12}(?:从事|岗位|工作|方向)",
    "no_value": r"(?:荣誉|奖项|证书)\s*[：:]?\s*(?:无|暂无|没有|待补充)\s*$",
    "took_part": "(?:参与|组织|负责|参加|协助|策划).{0,24}(?:大赛|竞赛|活动)",
    "won": "获奖|荣誉|奖学金|一等奖|二等奖|三等奖|提名|称号|优秀(?:学生|团队|个人|志愿者)",
    "grades": "(?i)学业成绩|专业排名|绩点|GPA",
    "rank": "奖学金|学业表现|排名前|专业前",
    "team": "实习生|医院|患者|科室|公司|团队|部门",
    "praise": "优秀|提名|好评|表彰|荣誉",
    "school_training": "学校实训|在校实训",
    "campus_doing": "活动|组织|策划|实践|任职|担任|经历",
    "skill_start": r"^[-–—•·\s]*(?:熟练|掌握|了解|办公软件|证书)",
    "skill_heading": "专业技能|职业技能|办公软件|设计剪辑|技能专长|技能清单",
    "skill_label": r"^(?:新媒体运营|视频剪辑|平面设计|办公软件|综合能力|内容创作|排版与设计|平台熟悉度|计算机技能|外语技能)\s*[：:]",
    "several": "^(?:[^、,，]*[、,，]){2}",
    "list_only": rf"^(?=.*、)[{_HAN}A-Za-z0-9+#.、，,/／\s-]{{2,40}}$",
    "character": "性格|为人|责任心|团队协作|抗压|共情",
    "virtue": "责任心|团队意识|抗压能力|适应能力|共情|岗位适配|综合素养",
    "advice": "实习简历|怎么写|课程作业|个人练习",
    "practice": "(?:课程作业|个人练习|自学|模仿).{0,20}(?:实习简历|练习|作品|笔记)|大学生实习",
    "certified": "资格证书|技能认证|能力证书|等级证书|证书：|证书:",
    "school_degree": "(?:大学|学院).{0,8}(?:本科|专科|专业|就读|毕业)",
    "ability": "期待|平台|沟通|性格|能力",
    "schooling": "就读|毕业|本科|专科|大专|硕士|博士|大学|学院",
    "studied": "就读|毕业于|专业|本科|专科|硕士",
    "studies": "就读|毕业于|教育背景|主修",
    "taught": "大学|学院|本科|专科|主修课程|就读|毕业",
    "school_name": "大学|学院|专业|本科|专科|大专|硕士|博士",
    "post": "担任|任职|任|干事|部长",
    "exam": "大学英语|英语[四六]级|计算机[一二三]级",
    "intern_word": "(?i)实习|intern",
    "employer": "公司|集团|工作室|医院",
    "held": "(?i)公司|集团|工作室|实习|任职",
    "workplace": "(?i)公司|集团|工作室|助理|岗位|职位|暑期|backend|frontend|产品|测试|运营|设计|开发|医院|护士",
    "works": r"^(?:实习|工作|岗位实践|工作实践)[：:\s]",
    "duty_task": "(?:负责|协助|配合|完成).{0,28}(?:工作|任务|素材|图片|运营|设计|处理|制作|物料|报表|客服|销售)",
    "numbered": r"^\s*\d+[、.)．]",
    "listed_honor": "奖学金|表彰|运动会|优秀团|优秀个人",
    "wish": "(?:希望|意向|求职|期望).{0,12}(?:从事|岗位|工作|方向)",
    "wished": "意向|求职|期望|应聘|希望",
    "in_post": "任职|担任|岗位|实习生",
    "title_label": "(?:助理|实习生|工程师|设计师|护士)[：:]",
    "title": "助理|实习生|工程师|设计师|护士",
    "did": "负责|参与|协助|筛选|安排|完成|接待|撰写|处理",
    "guide": "讲解员|研学|团支书|学生会|社团|志愿者|辅导员助理|文体委员|班长|部长|干事|(?:担任|任职).{0,16}(?:班|团|校|社区|协会|书院)",
    "expects": "(?:期待|希望|渴望|致力于).{0,20}(?:平台|机会|成长|发展)",
    "social": "社会实践|三下乡|志愿服务|校园活动|实践活动",
    "sport": "运动会|田径|百米|跳远|赛跑|辩论赛",
    "courses": "主修课程|专业课程|相关课程|课程列表",
    "own_work": "课程项目|毕业设计|项目经历|项目经验|实训项目",
    "built": "系统开发|平台开发|小程序开发",
    "product_word": "小程序|平台|系统|实训",
    "course_design": "课程设计",
    "project_noun": "项目|小程序|平台|毕业设计|课题|实训|系统",
    "media": "账号|视频号|公众号|社群|短片|海报|片头|包装|拍摄|小红书|抖音|微博",
    "media_project": "(?:公众号|账号|视频号|小红书|抖音|微博).{0,30}项目|运营项目|账号项目",
    "deliverable": "项目|小程序|平台|网站|毕业设计|实训|课题|：|:|负责|完成|参与|开发|实现|上线|搭建",
    "project_mark": "项目|小程序|平台|网站|毕业设计|实训|课题|：|:",
    "working": "(?i)实习|intern|项目|小程序|平台",
    "direction": rf"^[{_HAN}·]{{2,4}}\s*[|/／]\s*.{{1,16}}$",
    "major_first": rf"^[{_HAN}·]{{0,2}}(?:{_MAJOR})[{_HAN}·]{{0,2}}\s*[|/／]",
    "name": rf"^[{_HAN}·]{{2,4}}$",
    "no_name": r"\d{4}|简历|大学|学院|专业|意向|岗位|求职|^(?:个人|基本信息|个人信息|联系方式|电话|邮箱|手机|微信)$",
    "clear": r"(?i)实习|intern|公司|集团|工作室|任职于|担任|^(?:负责|参与|协助|主导|完成|开发|搭建|上线)(?:[\s，,：:]|$)",
    "volunteer": "社会实践|志愿|辅导员|讲解|研学",
    "team_honor": "荣誉|优秀团队|运动会|奖学金",
    "honor_mark": "计算机[一二三]级|普通话|奖学金|优秀|竞赛|奖",
    "self": "具备|善于|热爱|期待|责任心|沟通|适应|严谨|共情",
    "project_title": rf"(?i)^[·•—【\[-]?(?:20\d{{2}}.{{0,18}})?(?:项目经历|项目经验|课程项目|毕业设计|实训项目|项目作品|个人作品|作品集|[^：:]{{1,30}}(?:项目|小程序|平台|系统|网站|课题))[：:|｜]",
    "heading_form": rf"^[一二三四五六七八九十]+[、.．]|^[（(]?[0-9一二三四五六七八九十]+[）).、．]|[:：]$|^[^\n]{{1,18}}$",
    "degree_first": r"^\s*(?:专科|本科|大专|硕士|博士|研究生)",
    "named_school": rf"[{_HAN}A-Za-z]{{2,24}}(?:大学|学院)",
}
#: Lengths that a line, or a line without blanks, may have.
SIZES = {"raw10": (False, 10, None), "raw16": (False, 16, None), "raw24": (False, None, 24), "raw180": (False, None, 180), "over160": (False, 161, None), "name4": (False, 4, None), "tight6": (True, 6, None), "tight10": (True, 10, None), "tight12": (True, 12, None), "tight16": (True, 16, None), "tight18": (True, None, 18), "over100": (True, 101, None), "tight8": (True, 8, None), "label8": (True, None, 8)}
#: What signals say together: any of the clauses; in a clause all names hold, but for those after ! that may not.
PREDICATES = {
    "intent": ("intent_word", "hope"),
    "vain_award": ("no_value", "over160 !honor_heading", "took_part !won"),
    "award": ("award_word !vain_award", "award_context certificate !vain_award"),
    "honored": ("award", "award_context"),
    "no_education": ("contact", "certified !school_degree", "ability !schooling", "action !studied"),
    "school_post": ("post !studied", "exam !studies"),
    "education_only": ("studies !no_education", "school school_name !school_post !no_education"),
    "education_honor": ("grades rank",),
    "experience_honor": ("team praise",),
    "campus": ("campus_org", "campus_context school_training", "campus_context campus_doing !product", "campus_context raw24 !product"),
    "campus_role": ("guide", "campus"),
    "skill_list": ("several", "list_only"),
    "skill": ("skill_heading", "skill_word raw180"),
    "busy": ("action", "working"),
    "no_prose": ("award", "education_only", "intent", "advice", "skill_start !prose_start", "skill_list skill_word !prose_start !character"),
    "prose": ("prose_start tight10 !no_prose", "soft tight16 !no_prose", "virtue raw16 tight10 !no_prose"),
    "profile_skill": ("skill_label !date !held",),
    "no_intern": ("education_only", "intent", "skill_list !intern_word !employer", "profile_skill", "prose !intern_word !employer", "numbered listed_honor", "practice", "advice", "wish"),
    "dated_post": ("date org !campus_role",),
    "worked": ("intern_word action", "intern_word workplace", "intern_word raw10", "dated_post employer", "dated_post intern_word", "works !dated_post", "employer action", "duty_task employer", "duty_task intern_word", "duty_task date !dated_post"),
    "internship": ("worked !no_intern",),
    "no_strong": ("advice", "intent", "education_only", "campus_role !employer", "intern_word wished"),
    "evident": ("intern_word", "employer action", "employer date", "employer in_post", "title_label tight6", "title did"),
    "strong": ("evident !no_strong",),
    "no_project": (
        "expects", "social !own_work !built", "sport !own_work !product_word", "courses !own_work !course_design", "award", "skill_list !project_noun", "school !action", "media !media_project", "over100 !project_title", "major tight18 !deliverable",
    ),
    "project": ("project_word !no_project",),
    "opening_prose": ("prose_start !strong !award",),
    "person": ("name !no_name !contact !heading !major", "name !no_name !contact !heading !name4"),
    "named": ("direction !major_first !contact",),
    "leaves_summary": ("award", "education_only", "campus", "date", "clear", "skill_list skill !prose"),
    "soft_only": ("prose !taught",),
    "skill_leads": ("skill_start !prose_start", "skill_list skill_word !prose_start"),
    "no_recovery": ("award", "strong", "project", "education_only !prose", "summary_heading label8"),
    "recovered": ("prose !no_recovery", "soft tight8 !no_recovery"),
    "trailing": ("self tight12 !strong !award",),
}
#: Signals that no line without a Han character can meet: each of their alternatives holds one.
LETTERED = ("contact", "date", "skill_word", "award_word", "product", "grades", "intern_word", "held", "workplace", "numbered", "several", "list_only", "direction", "name", "no_name", "clear", "project_mark", "deliverable", "heading_form", "major_first")
_DIGIT, _TOOL = "/[0-9]/", "/(?:p[sr]|ae)(?![a-z])(?<![a-z]..)/"
#: What a line without a Han character holds, one of these at least, if it meets such a signal. Others of LETTERED say nothing by themselves there.
HINTS = {
    "contact": ("@", "wechat", "qq", _DIGIT), "date": (_DIGIT,), "award_word": ("uskills",), "product": ("app",), "grades": ("gpa",), "intern_word": ("intern",), "held": (), "workplace": ("backend", "frontend"),
    "skill_word": ("office", "excel", "word", "ppt", "wps", "python", "sql", "vue", "react", "canva", "photoshop", "premiere", "harmonyos", _TOOL), "list_only": ("、",), "direction": ("·",), "name": ("·",),
    "clear": ("intern",), "project_mark": ("：", ":"), "deliverable": ("：", ":"), "major_first": (),
}
_WORK = ("internship", "projects", "campus")
_BUT = lambda *names: tuple(s for s in SECTIONS if s not in names)
HAN = SectionRules(
    headings={h: section for section, names in HEADINGS.items() for h in names},
    #: A heading of the section whose words say otherwise; "" where it is none.
    resolve=(
        ("internship", "荣誉|优秀|奖项|奖学金|运动会|表彰|先进|标兵|提名", "awards"), ("internship", "(?=.*(?:项目|课堂|课程)).*(?:实践|经历|实训)", "projects"), ("internship", "校园|社团|志愿|学生会|学生工作|在校", "campus"),
        ("internship", r"^[（(【\[]?社会实践[)）】\]]?$", ""),
    ),
    anywhere=("项目一", "项目二", "项目三"), no_field="经历|经验|实习|项目|公司|集团|医院|负责|参与", inline=INLINE, labels=LABELS, signals=SIGNALS, compact=("project_title",), sizes=SIZES, predicates=PREDICATES,
    empty={"awards": "no_value"},
    opens=(
        (None, "contact", "basic_info"), (None, "intent", "basic_info"), (("internship", "campus"), "experience_honor", "="), (("education",), "education_honor", "="), (None, "honored", "awards"), (None, "campus", "campus"),
        (_BUT("internship"), "project", "projects"), (_BUT("projects", "internship", "education", "campus"), "skill_word", "skills"), (None, "summary_heading", "summary"), (("summary",), "soft", "summary"), (("summary",), "prose", "summary"),
        (_BUT(*_WORK), "opening_prose", "summary"), (_BUT("education", "skills", "awards"), "internship", "internship"), (None, "date school", "education"), (None, "date org", "internship"), (_BUT("skills", "projects", "internship"), "school", "education"),
    ),
    switches=(
        (None, None, None, "heading_form !date", True), (None, None, None, "numbered", True), (("education",), ("projects",), None, "!project_mark", False), (_WORK, ("skills", "summary"), None, "prose", True), (_WORK, ("skills", "summary"), None, "", False),
        (None, ("projects", "internship"), None, "date", True), (None, ("projects", "internship"), None, "project_word", True), (None, ("projects", "internship"), None, "internship", True), (None, ("campus", "awards", "summary"), None, "", True),
        (None, ("basic_info", "education", "skills"), False, "", True), (("summary", "basic_info"), ("basic_info", "education", "skills", "awards", "campus"), None, "", True),
    ),
    refine=(
        (None, "intent", "basic_info"), (("summary",), "!leaves_summary", "="), (("summary",), "prose", "="), (("internship", "campus"), "experience_honor", "="), (("education",), "education_honor", "="), (("education",), "school !soft_only", "="),
        (("education",), "major !soft_only", "="), (None, "named", "basic_info"), (None, "contact", "basic_info"), (None, "person", "basic_info"), (None, "honored", "awards"), (None, "campus", "campus"),
        (("projects",), "internship intern_word !advice", "internship"), (("projects",), "", "="), (_BUT("internship"), "project", "projects"), (None, "internship", "internship"), (_BUT(*_WORK), "skill", "skills"), (_WORK, "skill !busy", "skills"),
        (None, "summary_heading", "summary"), (("summary",), "soft", "summary"), (_BUT(*_WORK), "opening_prose", "summary"), (None, "prose", "summary"), (None, "school !org", "education"), (None, "major !org !action", "education"),
    ),
    moves=(
        Move(("basic_info", "summary", "skills", "campus"), "education_only", "education"),
        Move(("skills", "summary", "basic_info", "projects", "internship"), "award", "awards"),
        Move(SECTIONS, "education_only", "education", first=True, copy=True, if_empty=True),
        Move(SECTIONS, "strong", "internship", first=True, copy=True, if_empty=True),
        Move(SECTIONS, "skill !award !education_only", "skills", first=True, copy=True, if_empty=True),
        Move(SECTIONS, "recovered", "summary", around="summary", also="trailing", stops="skill_list !prose"),
        Move(SECTIONS, "prose prose_start", "summary", first=True, if_empty=True, no_heading="summary"),
        # of an internship with evidence honours and skills go; of one without all goes
        Move(("internship",), "award !strong", "awards", held=("internship", "strong", True)), Move(("internship",), "profile_skill !strong", "skills", held=("internship", "strong", True)),
        Move(("internship",), "campus_role", "campus", held=("internship", "strong", False)), Move(("internship",), "volunteer", "campus", held=("internship", "strong", False)), Move(("internship",), "award", "awards", held=("internship", "strong", False)),
        Move(("internship",), "team_honor", "awards", held=("internship", "strong", False)), Move(("internship",), "profile_skill", "skills", held=("internship", "strong", False)), Move(("internship",), "skill !action", "skills", held=("internship", "strong", False)),
        Move(("internship",), "prose", "summary", held=("internship", "strong", False)), Move(("internship",), "project", "projects", held=("internship", "strong", False)), Move(("internship",), "intent", "basic_info", held=("internship", "strong", False)),
        Move(("internship",), "", "campus", held=("internship", "strong", False)),
        Move(("summary",), "skill_leads", "skills"),
        Move(("education", "basic_info", "summary"), "skill !education_only", "skills", first=True, if_empty=True, heading="skills"),
        Move(("skills", "education", "basic_info", "campus"), "certificate !intent !strong", "awards", first=True, if_empty=True, heading="awards"), Move(("skills", "education", "basic_info", "campus"), "honor_mark !intent !strong", "awards", first=True, if_empty=True, heading="awards"),
    ),
    #: Parts of lines that are lines of another section: of which section, where, what and whither; and what then leaves that one.
    fragments=(("internship", "action", rf"([{_HAN}A-Za-z]{{2,24}}(?:大学|学院))", "education"), ("awards", "degree_first", r"^\s*(.*?)[\s，,;；]*(?:获得|荣获|证书|称号|$)", "education"), ("awards", "", rf"([{_HAN}A-Za-z]{{2,24}}(?:大学|学院))", "education")),
    makes_room=("org !named_school",),
    guard=(f"[{_HAN}]", tuple(n for n in SIGNALS if n not in LETTERED)),
    hints=HINTS,
)
