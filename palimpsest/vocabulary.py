"""Word lists that decide results. They must equal the published ones."""

from __future__ import annotations

# fixed values: predicates whose values accumulate instead of replacing each other
MULTI_VALUED = (
    "likes", "dislikes", "prefers", "enjoys", "loves", "hates", "avoids", "wants", "interested_in",
    "owns", "has", "bought", "purchased", "visited", "traveled_to", "went_to", "been_to",
    "knows", "met", "friends_with", "read", "watched", "played", "listened_to", "tried", "ate",
    "speaks", "allergic_to", "has_pet", "has_child", "plans", "plans_to", "recommends", "mentioned",
    "uses", "needs", "considering",
    "colleague", "coworker", "co_worker", "friend", "sister", "brother", "mother", "father",
    "parent", "child", "spouse", "wife", "husband", "partner",
    "goal", "goals", "hopes", "wishes", "aspires", "working_on", "works_on", "work_on",
    "rule", "preference", "decision", "note",
    "project_rule", "project_preference", "project_decision", "project_note", "agent_instruction",
    "made", "makes", "ordered", "booked", "accepted", "inherited", "received", "sent", "gave",
    "asked", "discussed", "did", "attended", "used_service", "celebrated", "experienced",
)

# fixed values: words that do not count when one object is compared with another
OBJECT_STOP = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "is", "are", "was",
    "were", "my", "his", "her", "their", "with", "for", "as", "by",
)

# fixed values: preference polarity in conflict resolution
LIKE_PREDICATES = (
    "likes", "like", "loves", "love", "enjoys", "enjoy", "prefers", "prefer", "favorite",
    "favourite", "fond_of", "into", "interested_in", "fan_of",
)
LIKE_PREFIXES = ("favorite", "favourite", "likes_", "loves_", "enjoys_", "prefers_")
DISLIKE_PREDICATES = ("dislikes", "dislike", "hates", "hate", "avoids", "avoid", "not_into", "disinterested_in")
DISLIKE_PREFIXES = ("dislikes_", "dislike_", "hates_", "avoids_", "doesn't_", "does_not_")

# fixed values: predicates exempt from forgetting, beside those that begin with "favorite"
DURABLE = (
    "likes", "dislikes", "prefers", "avoids", "loves", "hates", "enjoys", "wants", "allergic_to",
    "interested_in", "name", "works_at", "lives_in", "born_in", "married_to", "occupation", "speaks",
)

# fixed values: categories in order of priority, with the strings that put a fact there
CATEGORIES = (
    ("健康", ("allerg", "disease", "condition", "diagnos", "medication", "symptom", "pregnan", "disab",
              "diabet", "blood_type", "health", "病", "过敏", "怀孕", "孕", "残疾", "症", "药")),
    ("财务", ("salary", "income", "wage", "bank", "credit_card", "debt", "net_worth", "mortgage",
              "invest", "工资", "收入", "薪", "银行", "信用卡", "负债", "存款", "理财")),
    ("身份", ("name", "age", "gender", "sex", "birthday", "born", "nationality", "occupation", "job",
              "profession", "education", "degree", "id_number", "passport", "ssn",
              "姓名", "年龄", "性别", "生日", "国籍", "职业", "学历", "身份证", "护照")),
    ("位置", ("lives_in", "home", "address", "based_in", "located", "poi", "住", "地址", "常住")),
    ("关系", ("married", "spouse", "partner", "child", "kids", "family", "friend", "colleague", "boss",
              "relationship", "配偶", "孩子", "家人", "朋友", "同事")),
    ("工作", ("works_at", "employer", "company", "project", "works_on", "团队", "公司", "项目")),
    ("偏好", ("like", "love", "enjoy", "prefer", "favorite", "favourite", "dislike", "hate", "avoid",
              "interested", "fan_of", "喜欢", "讨厌", "偏好", "最爱")),
    ("事件", ("visit", "went", "trip", "bought", "ordered", "attended", "plan", "booked", "去", "买", "计划")),
)
OTHER = "其他"

# fixed values: what makes a fact sensitive
SENSITIVE_WORDS = (
    "allerg", "disease", "diagnos", "medication", "diabet", "hiv", "cancer", "depress", "anxiety",
    "pregnan", "disab", "mental", "blood_type", "symptom", "病", "过敏", "怀孕", "抑郁", "残疾", "药",
    "salary", "income", "wage", "bank_account", "credit_card", "debt", "net_worth", "mortgage",
    "工资", "薪资", "收入", "银行卡", "信用卡", "负债", "存款",
    "password", "passcode", "ssn", "passport", "id_number", "secret", "密码", "身份证", "护照", "密钥",
    "religion", "religious", "christian", "muslim", "buddhis", "political", "gay", "lesbian", "bisexual",
    "sexual_orientation", "宗教", "政治", "性取向",
)
SENSITIVE_PREDICATES = (
    "salary", "income", "password", "ssn", "passport", "id_number", "religion",
    "political_affiliation", "sexual_orientation", "medical_condition", "allergic_to",
    "has_disease", "blood_type", "bank_account", "credit_card",
)

# fixed values: identity predicates, their profile field and its label
BASIC_FIELDS = {
    "name": ("name", "姓名"),
    "age": ("age", "年龄"), "age_range": ("age", "年龄"),
    "gender": ("gender", "性别"), "sex": ("gender", "性别"),
    "occupation": ("occupation", "职业"), "job": ("occupation", "职业"),
    "profession": ("occupation", "职业"), "works_as": ("occupation", "职业"),
    "works_at": ("employer", "工作单位"), "employer": ("employer", "工作单位"), "company": ("employer", "工作单位"),
    "lives_in": ("home", "常住地"), "home": ("home", "常住地"), "based_in": ("home", "常住地"), "lives_at": ("home", "常住地"),
    "born_in": ("birthplace", "出生地"), "birthplace": ("birthplace", "出生地"),
    "birthday": ("birthday", "生日"), "born_on": ("birthday", "生日"), "birth_date": ("birthday", "生日"),
    "married_to": ("spouse", "配偶"), "spouse": ("spouse", "配偶"),
    "has_child": ("children", "子女"), "has_children": ("children", "子女"), "children": ("children", "子女"), "kids": ("children", "子女"),
    "nationality": ("nationality", "国籍"),
    "speaks": ("language", "语言"), "language": ("language", "语言"),
    "education": ("education", "教育"), "studied_at": ("education", "教育"),
    "graduated_from": ("education", "教育"), "degree": ("education", "教育"),
}
SEVERAL_AT_ONCE = ("children", "language", "education")

# fixed values: polarity and habits in the profile
PROFILE_LIKE = (
    "likes", "like", "loves", "love", "enjoys", "enjoy", "prefers", "prefer", "favorite",
    "favourite", "interested_in", "fan_of", "into", "fond_of", "wants", "wishes_for",
)
PROFILE_LIKE_PREFIXES = ("favorite", "favourite", "likes_", "loves_", "enjoys_", "prefers_", "prefer_", "interested", "fond_", "fan_")
PROFILE_DIET = ("diet", "dietary_restriction", "dietary_restrictions")
PROFILE_DISLIKE = (
    "dislikes", "dislike", "hates", "hate", "avoids", "avoid", "allergic_to", "allergic",
    "cannot_eat", "cant_eat", "not_into", "disinterested_in",
)
PROFILE_DISLIKE_PREFIXES = (
    "dislikes_", "dislike_", "hates_", "avoids_", "avoid_", "allergic", "cannot_", "doesn't_", "does_not_", "do_not_", "not_", "no_",
)
HABITS = (
    "usually", "often", "routine", "regularly", "habit", "tends_to", "commutes", "frequently",
    "daily", "weekly", "every_day", "every_week", "every_morning",
)
PREFERENCE_GROUPS = (
    ("健康禁忌", ("allergic", "allergy", "intoleran", "过敏", "忌口", "禁忌")),
    ("饮食", ("food", "eat", "cuisine", "dish", "restaurant", "drink", "coffee", "tea", "spicy",
              "seafood", "meal", "cook", "snack", "fruit",
              "吃", "餐", "菜", "料", "火锅", "辣", "香菜", "甜", "咖啡", "茶", "清淡", "评分", "人均", "口味")),
    ("出行", ("travel", "trip", "destination", "hotel", "route", "drive", "flight", "scenery", "poi",
              "酒店", "住宿", "民宿", "高架", "路线", "停车", "充电", "景点", "旅游", "出差", "导航", "自驾")),
    ("音乐", ("music", "song", "artist", "singer", "band", "genre", "playlist",
              "歌", "音乐", "曲", "电音", "流行", "周杰伦", "五月天", "华语", "粤语", "民谣", "摇滚")),
    ("影视", ("movie", "film", "show", "tv", "series", "video", "cinema", "drama", "director",
              "片", "电影", "电视剧", "影视", "恐怖", "科幻", "诺兰", "导演", "综艺", "动画")),
    ("运动", ("sport", "exercise", "gym", "run", "fitness", "yoga", "basketball", "football", "hike",
              "跑步", "游泳", "健身", "篮球", "足球", "瑜伽", "运动", "球", "爬山", "登山")),
    ("阅读", ("book", "read", "author", "novel", "podcast", "news", "书", "阅读", "新闻", "播客", "股票")),
    ("兴趣", ("跳舞", "探店", "摄影", "自拍", "烘焙", "绘画", "手工")),
    ("环境", ("安静", "氛围", "环境", "嘈杂", "空调", "温度", "座椅", "加热")),
)
SELF_WORDS = ("user", "用户", "i", "我", "me", "myself", "本人", "自己", "俺")
PROFILE_KEYS = ("works_at", "lives_in", "name", "born_in", "married_to", "occupation", "job_title", "age", "diet")

# fixed values: retrieval weights by kind of fact
PREFERENCE_PREDICATES = (
    "likes", "dislikes", "prefers", "avoids", "loves", "hates", "enjoys", "wants",
    "allergic_to", "interested_in", "favorite", "prefers_to",
)
IDENTITY_PREDICATES = (
    "name", "works_at", "lives_in", "born_in", "married_to", "occupation", "age", "studied_at", "owns", "has", "speaks",
)

# fixed values: query words for a relation
RELATION_WORDS = {
    "works_at": ("work", "works", "working", "employer", "employed", "employment", "company", "job"),
    "occupation": ("profession", "role", "title", "job", "career"),
    "lives_in": ("live", "lives", "living", "reside", "resides", "city", "home", "location", "where"),
    "based_in": ("based", "base", "located", "location", "headquarter", "headquarters", "hq", "city", "where"),
    "located_in": ("located", "location", "based", "headquarter", "headquarters", "hq", "city", "where"),
    "works_on": ("project", "work", "works", "working", "built", "building"),
    "project": ("project", "initiative", "work"),
    "colleague": ("colleague", "coworker", "co-worker", "workmate"),
    "sister": ("sister", "sibling"),
    "brother": ("brother", "sibling"),
    "spouse": ("spouse", "wife", "husband", "partner"),
    "wife": ("spouse", "wife", "partner"),
    "husband": ("spouse", "husband", "partner"),
    "manager": ("manager", "boss", "lead"),
    "likes": ("like", "likes", "favorite", "interest"),
    "favorite": ("favorite", "favourite", "likes", "prefers"),
}
ANCHOR_STOP = (
    "the", "and", "for", "with", "from", "inc", "ltd", "llc", "corp", "co", "company", "project",
    "user", "assistant", "team", "group", "system", "ai",
)
VALUE_PREDICATES = (
    "based_in", "located_in", "headquartered_in", "lives_in", "works_at", "occupation",
    "likes", "dislikes", "prefers", "favorite", "owns", "has", "diet", "allergic_to",
)
EXCLUSION_CUE = (
    r"(?:\bnot\b(?:\s+\w+){0,5}|\bexcept\b(?:\s+\w+){0,4}|\bexcluding\b(?:\s+\w+){0,4}|"
    r"\bexclude\b(?:\s+\w+){0,4}|\bother\s+than\b(?:\s+\w+){0,4}|"
    r"\brather\s+than\b(?:\s+\w+){0,4}|\bbesides\b(?:\s+\w+){0,4}|不是|不在|排除|除了)\s*$"
)
SELF_ANCHOR = r"\b(i|me|my|mine|myself|we|our|ours|user's|the user's|their|his|her)\b|我|我的|用户|用户的"

# fixed values: the multi-hop planner
CHAIN_WORDS = (
    (("colleague", "coworker", "co-worker"), "colleague"),
    (("sister",), "sister"),
    (("brother",), "brother"),
    (("mother", "mom"), "mother"),
    (("father", "dad"), "father"),
    (("parent",), "parent"),
    (("child",), "child"),
    (("spouse", "wife", "husband", "partner"), "spouse"),
    (("project", "projects", "initiative", "initiatives", "works_on", "worked_on"), "works_on"),
    (("work", "works", "working", "employer", "company", "job", "employed"), "works_at"),
    (("profession", "occupation", "role", "title"), "occupation"),
    (("live", "lives", "living", "city", "reside", "resides"), "lives_in"),
    (("based", "located", "location", "headquarters", "headquarter", "hq"), "based_in"),
)
CHAIN_RELATIONS = ("colleague", "sister", "brother", "mother", "father", "parent", "child", "spouse", "works_on")
CHAIN_ANSWERS = ("works_at", "occupation", "lives_in", "based_in")
CHAIN_PLACES = ("based_in", "located_in", "headquartered_in")
CHAIN_PROJECTS = ("works_on", "project", "worked_on", "built", "building")

# fixed values: predicates that hold text and never become graph edges
OUTCOME_KINDS = ("decision", "finding", "lesson", "open_question")
TEXT_PREDICATES = ("procedure", "how_to", "routine", "instruction", "agent_instruction", *OUTCOME_KINDS)

# fixed values: other words for a predicate
PREDICATE_ALIASES = (
    (("works_at", "employer", "company"), " work works worked employer employed employment company job"),
    (("lives_in", "location", "city", "home"), " live lives lived location city home"),
)

# fixed values: phrases of answers that do not answer, and of questions that call for counting or for advice
ABSTENTION_MARKS = (
    "don't know", "do not know", "not mentioned", "no information", "cannot find",
    "not sure", "unknown", "not stated", "doesn't mention", "isn't mentioned", "no answer",
)
MORE_ABSTENTION_MARKS = ("does not mention",)
COUNT_QUESTIONS = (
    "how many", "how much", "how often", "number of", "total number", "in total",
    "altogether", "combined", "count of", "how long", "how old", "list all", "all the",
)
ADVICE_QUESTIONS = (
    "recommend", "suggest", "what should i", "what would i", "would i prefer", "help me",
    "advice", "i'm planning", "im planning", "i am planning", "i'm thinking", "what kind of",
    "what type of", "which one should", "any ideas", "what do you suggest",
)

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# fixed values: statements of a passing state
EPHEMERAL_MARKS = (
    "today", "right now", "currently", "this morning", "this afternoon", "tonight", "this week",
    "for now", "at the moment", "temporarily", "this trip", "feeling a bit", "i feel ",
    "今天", "现在", "此刻", "暂时", "这会儿", "待会", "等下", "本次", "这趟", "这次", "最近想", "改天",
)

# fixed values: standing instructions
PROCEDURE_PREDICATES = (
    "wants", "wants_reminder", "instruction", "prefers", "prefers_format", "asks_to", "always",
    "never", "remind", "rule", "routine", "how_to", "procedure", "wants_me_to",
)
PROCEDURE_PREFIXES = ("wants_", "prefers_", "remind_")
PROCEDURE_QUERY = (
    r"\b(how\s+(?:do|should|can|to|would|am|is)|procedure|process|workflow|runbook|instruction|"
    r"rule|policy|protocol|steps?|checklist|always|never|remind|remember\s+to)\b|"
    r"怎么|如何|步骤|流程|规则|指令|操作|办法|提醒|记得"
)
HISTORY_QUERY = (
    r"\b(before|previous|previously|former|formerly|used\s+to|past|old(?:er)?|prior)\b|"
    r"以前|之前|曾经|过去|原来|从前|上一"
)
PREFERENCE_MARKS = (
    "like", "dislike", "prefer", "favorite", "favourite", "love", "hate", "avoid", "allergic", "interested", "diet",
)

# fixed values: the kind of answer a question asks for, and objects of that kind
ANSWER_CUES = {
    "email": ("email", "e-mail", "邮箱", "邮件地址"),
    "url": ("url", "链接", "网址", "link to"),
    "phone": ("phone number", "telephone", "电话", "手机号", "联系电话", "phone"),
    "id": ("id", "编号", "工单号", "订单号", "identifier", "order number", "ticket number", "serial"),
    "date": ("what date", "which day", "date of", "日期", "什么时候", "哪天", "哪一天", "几号", "哪一年"),
    "number": ("how many", "how much", "number of", "多少", "几个", "数量", "几次", "几年", "几岁"),
}
ANSWER_SHAPES = {
    "email": r"[^@\s]+@[^@\s]+\.[^@\s]+",
    "url": r"https?://|www\.",
    "phone": r"\+?\d[\d\s().\-]{6,}\d",
    "id": r"\d",
    "date": r"\b\d{4}\b|\d{1,2}[-/]\d{1,2}|年|月|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec",
    "number": r"\d",
}

# fixed values: credentials that importers mask
SECRET_SHAPES = (
    r"\b(sk-[A-Za-z0-9_\-]{16,})",
    r"\b(gh[pousr]_[A-Za-z0-9]{20,})",
    r"\b(xox[baprs]-[A-Za-z0-9\-]{10,})",
    r"\b(AKIA[0-9A-Z]{16})\b",
    r"\b(eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,})",
)
SECRET_ASSIGNMENT = r"((?:API[_-]?KEY|SECRET|TOKEN|PASSWORD|PASSWD|CREDENTIAL)\s*[=:]\s*)([^\s\"']{8,})"
REDACTED = "[REDACTED]"

# fixed values: weights, limits and priorities of the evidence packer
BLOCK_TITLES = (
    ("PROVENANCE RAW", "provenance"), ("RELEVANT CONVERSATIONS", "raw"), ("GRAPH PATHS", "graph"), ("AGGREGATION", "aggregation"),
    ("DURATION", "duration"), ("FACT HISTORY", "history"), ("FACT EVOLUTION", "evolution"), ("CURRENT STATE", "current_state"),
    ("PREFERENCE RECORDS", "preference"), ("PROCEDURAL MEMORY", "procedural"), ("FACTS", "facts"), ("SESSION SUMMARIES", "summaries"),
    ("TIMELINE", "timeline"), ("WORKING MEMORY", "working"), ("USER PROFILE", "profile"),
)
BLOCK_PRIORITY = {
    "working": 95, "facts": 90, "current_state": 88, "procedural": 86, "provenance": 82, "raw": 78, "graph": 76, "history": 75,
    "evolution": 72, "timeline": 68, "aggregation": 66, "duration": 66, "preference": 66, "summaries": 58, "profile": 38, "other": 40,
}
INTENT_BONUS = {
    "exact_lookup": {"provenance": 45, "raw": 35, "facts": 20},
    "multi_hop": {"graph": 45, "facts": 25, "provenance": 15, "raw": 12},
    "aggregation": {"aggregation": 55, "raw": 35, "summaries": 30, "facts": 10},
    "duration": {"duration": 55, "raw": 35, "timeline": 25, "summaries": 15},
    "history": {"history": 55, "evolution": 40, "timeline": 20, "facts": 15},
    "procedural": {"procedural": 55, "facts": 18, "provenance": 15, "raw": 12, "summaries": 8},
    "current_state": {"current_state": 45, "facts": 20, "evolution": 20},
    "preference": {"preference": 45, "facts": 18, "provenance": 12, "raw": 10},
    "timeline": {"timeline": 35, "history": 15, "facts": 10},
}
BLOCK_SHARE = {
    "aggregation": 0.60, "duration": 0.55, "provenance": 0.55, "raw": 0.55, "graph": 0.45, "history": 0.45, "evolution": 0.42, "facts": 0.42,
    "timeline": 0.35, "summaries": 0.35, "current_state": 0.35, "procedural": 0.38, "preference": 0.35, "working": 0.25, "profile": 0.18, "other": 0.25,
}

# fixed values: how a fact with Chinese content reads; {o} is its object
DISPLAY = {
    "name": "名字是 {o}", "age": "年龄 {o}", "age_range": "年龄段 {o}", "gender": "性别 {o}",
    "occupation": "职业是 {o}", "job": "职业是 {o}", "profession": "职业是 {o}",
    "works_at": "在 {o} 工作", "employer": "在 {o} 工作", "company": "在 {o} 工作",
    "works_on": "在做 {o}", "works_in": "在 {o} 工作",
    "lives_in": "住在 {o}", "home": "家在 {o}", "based_in": "常驻 {o}", "lives_at": "住在 {o}",
    "born_in": "出生于 {o}", "birthplace": "出生于 {o}", "birthday": "生日是 {o}",
    "nationality": "国籍 {o}", "speaks": "会说 {o}", "language": "语言 {o}",
    "education": "教育：{o}", "studied_at": "就读于 {o}", "graduated_from": "毕业于 {o}", "degree": "学位 {o}",
    "married_to": "配偶是 {o}", "spouse": "配偶是 {o}", "partner": "伴侣是 {o}",
    "has_child": "有孩子 {o}", "has_children": "有孩子 {o}", "have_child": "有孩子 {o}",
    "have_children": "有孩子 {o}", "children": "孩子：{o}", "kids": "孩子：{o}",
    "job_title": "职位是 {o}", "title": "职位是 {o}", "position": "职位是 {o}", "role": "职位是 {o}",
    "friends_with": "和 {o} 是朋友", "knows": "认识 {o}", "colleague": "同事 {o}", "boss": "老板是 {o}",
    "likes": "喜欢 {o}", "loves": "很喜欢 {o}", "enjoys": "喜欢 {o}", "prefers": "偏好 {o}",
    "interested_in": "对 {o} 感兴趣", "fan_of": "是 {o} 的粉丝", "fond_of": "喜欢 {o}",
    "dislikes": "不喜欢 {o}", "hates": "讨厌 {o}", "avoids": "避免 {o}",
    "allergic_to": "对 {o} 过敏", "cannot_eat": "不能吃 {o}",
    "owns": "拥有 {o}", "has": "有 {o}", "has_pet": "养了 {o}",
    "visited": "去过 {o}", "traveled_to": "去过 {o}", "been_to": "去过 {o}", "went_to": "去过 {o}",
    "bought": "买了 {o}", "ordered": "点了 {o}", "plans": "计划 {o}", "plans_to": "计划 {o}",
    "wants": "想要 {o}", "needs": "需要 {o}", "goal": "目标：{o}", "uses": "用 {o}",
    "has_disease": "患有 {o}", "medication": "在用药 {o}", "salary": "薪资 {o}", "income": "收入 {o}",
    "plays": "会 {o}", "watches": "看 {o}", "reads": "读 {o}", "listens_to": "听 {o}",
    "studies": "学 {o}", "learns": "学 {o}", "learning": "在学 {o}", "drives": "开 {o}",
    "practices": "练 {o}", "eats": "吃 {o}", "drinks": "喝 {o}", "cooks": "做 {o}",
    "mentioned": "提到 {o}", "asked": "问过 {o}", "recommends": "推荐 {o}", "considering": "在考虑 {o}",
    "follows": "关注 {o}", "frequents": "常去 {o}", "frequently_visits": "常去 {o}", "visits": "去 {o}",
    "uses_video_platform": "用 {o}", "uses_platform": "用 {o}", "enrolled_in": "就读 {o}",
    "had": "做过 {o}", "won": "中了 {o}", "habits": "习惯 {o}", "habit": "习惯 {o}", "wants_to": "想 {o}",
    "going_to": "要去 {o}", "plans_to_travel": "计划去 {o}", "appointment": "预约 {o}",
}
FAVOURITES = {
    "color": "颜色", "food": "食物", "music": "音乐", "movie": "电影", "film": "电影", "song": "歌曲",
    "drink": "饮品", "sport": "运动", "book": "书", "place": "地方", "animal": "动物", "season": "季节",
    "hobby": "爱好", "city": "城市", "artist": "歌手", "singer": "歌手", "team": "球队", "brand": "品牌",
    "programming_language": "编程语言", "cuisine": "菜系", "fruit": "水果",
}
DISPLAY_SELF = ("user", "i", "me", "myself", "我", "你")
