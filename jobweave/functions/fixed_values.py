"""Word lists, patterns, labels and thresholds that define the results.

These must equal the values of the pipeline being rebuilt, or results differ.
They are data, kept together and in their natural order.
"""

# --- fixed values: seed phrases of the three requirement classes
SKILL_SEEDS = [
    "熟悉Python、SQL、Excel等数据分析工具",
    "掌握PLC编程与电气自动化设备调试",
    "具备项目管理、需求分析和实施能力",
    "熟练使用Office办公软件和项目管理工具",
    "熟悉软件开发流程、数据库和系统集成",
]
EXPERIENCE_SEEDS = [
    "至少3年相关工作经验",
    "5年以上制造业设备维护管理经验",
    "无需经验，实习生也可",
    "有项目管理经验者优先",
    "具备2年以上团队管理经验",
]
OTHER_SEEDS = [
    "具备良好的沟通协调能力和团队合作精神",
    "责任心强、抗压能力强、学习能力强",
    "能够适应高强度工作节奏，服从安排",
    "具有良好的职业素养和服务意识",
    "愿意出差，能接受不定期加班",
]

# --- fixed values: thresholds of the nearest-seed decision
SEED_EXPERIENCE_MIN = 0.45
SEED_SKILL_MIN = 0.45
SEED_OTHER_MIN = 0.40

# --- fixed values: text patterns, in the order in which they are tried
SECTION_HEADER = r"(任职要求|岗位要求|任职资格|任职条件)"
SECTION_LINE_START = r"(^|\n)\s*要求[:：]?"
SECTION_END = (
    r"(年龄要求|职能类别|工作内容|岗位职责|职位详情|福利待遇|薪资福利"
    r"|联系我们|公司介绍|公司福利|福利|岗位职责)"
)
BARE_HEADING = r"^(职位详情|工作内容|任职要求|岗位要求|任职资格|年龄要求|职能类别)[:：]?$"
IGNORE = [
    r"五险一金|带薪年假|年终奖金|绩效奖金|岗位福利|福利待遇|补贴|保险|住宿|餐补",
    r"薪资\s*\d+|月薪|年薪|工资|待遇",
    r"工作时间|周末双休|加班|9:00|18:00|午休|排班|休假",
    r"公司介绍|企业文化|团队年轻|氛围.*好|氛围轻松|期待你|等你来聊|加入我们",
    r"职位发布|邀约|面试|入职跟踪|招聘全流程",
    r"产品.*线|客户.*沟通|合作伙伴|业务拓展",
    r"办公地点|工作地点|联系方式|联系电话|邮箱",
    r"HRBP|船东|公司提供食宿|船舶|杂货船|周期|个月左右|\d+个月|本岗位|本公司|招聘人数|\d+\s*人|岗位性质|岗位类别",
    r"年龄要求|职能类别|学历要求|工作内容|岗位职责",
]
EDUCATION = r"学历|大专|本科|高中|硕士|博士|学位|应届毕业生|毕业生|专业背景|专业优先"
AGE = r"年龄|岁"
AGE_BLOCKED_BY = r"经验|年"
EXPERIENCE = r"无需经验|经验者优先|从业经验|工作经验|\d+\s*年|年以上|年及以上|半年|实习|经验丰富"
SKILL = (
    r"熟悉|熟练|掌握|了解|能够|擅长|技能|工具|软件|系统|平台|编程|开发|测试|运维|设计|分析|优化|实施"
    r"|配置|数据库|项目管理|沟通协调|沟通能力|团队协作|团队合作|写作|表达|英语|PMP|CISP|SAP|Oracle|ERP"
    r"|电脑|office|文档|报告|操作|维护|压力|工作压力"
)

# --- fixed values: characters
BULLETS = "-–—·•【】[]"
LEADING_COLONS = "：:"
SENTENCE_ENDS = r"(?<=[。；;])"
COLONS = r"(?<=(?<!\d)[：:])"
SEGMENT_BREAK = r"[；;，,]+"
SKILL_BREAK = r"[,;；]+"
TAG_BREAK = r"[,;；\s]+"
PHRASE_BREAKS = r"[；;。.!?,，、\n\r]"
OTHER_JOINER = "；"
PHRASE_MIN_CHARS = 10
PHRASE_TOP = 5

# --- fixed values: experience texts and salary labels
NO_EXPERIENCE = "无需经验"
WITHIN_ONE_YEAR = ["1年以内", "1年内"]
YEAR_RANGE = r"(\d+)\s*-\s*(\d+)\s*年"
YEARS_AND_UP = r"(\d+)\s*年\s*及以上"
YEARS_OVER = r"(\d+)\s*年\s*以上"
YEARS = r"(\d+)\s*年"
UNIT_FACTOR = {"万": 10000.0, "千": 1000.0, "元": 1.0}
PERIOD_FACTOR = {"月": 1.0, "年": 1.0 / 12.0, "天": 30.0, "单": 1.0}

# --- fixed values: skills, clusters, profiles
BUNDLE_SUFFIX = "技能包"
MERGE_MIN_CORRELATION = 0.75
SKILL_WEIGHT = 1.0
EXPERIENCE_WEIGHT = 8.0
OTHER_WEIGHT = 0.4
CLUSTER_MIN_JOBS = 10
MAX_CLUSTERS = 10
CLUSTER_RESTARTS = 10
CLUSTER_SEED = 42
UNKNOWN = "未知"
NO_VALUE = "N/A"
TOP_TITLES = 5
TOP_SKILLS = 10
TEXT_SAMPLE = 30
REPLY_NAME_CHARS = 20
REPLY_ITEMS = 5

# --- fixed values: salary analysis
REGRESSION_MIN_JOBS = 70
ROBUST_MIN_JOBS = 10
SKILL_BUDGET_MAX = 16
SKILL_BUDGET_MIN = 5
SVD_COMPONENTS = 3
TFIDF_MAX_TERMS = 200
EXPERIENCE_POWER = 1.5
EXPERIENCE_SPLIT_YEARS = 4
CURVE_YEARS = 10
NEIGHBOURS = 3
SELECTION_METHOD = "Mutual Information"
ROBUST_METHOD = "median_plus_coarse_matching"
ROBUST_MIN_ROWS = 3

# --- fixed values: warehouse
UNCLASSIFIED = "未分类"
