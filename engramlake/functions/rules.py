"""Extraction rules as data, compiled to columns.

A rule is a regular expression and what it means. Rules are compiled with
Unicode classes and line ends as the source of the rules expects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramlake.functions.text import strip

# Domains whose memories are guarded.
GUARDED_DOMAINS = ("health", "finance")

# Gate patterns and their categories, in order of priority.
GATE_PATTERNS = (
    (r"我(?:叫|是|名字是)\s*(.+)", "identity"),
    (r"(?:my name is|i'm|i am)\s+(.+)", "identity"),
    (r"我(?:喜欢|爱|偏好|倾向于)\s*(.+)", "preference"),
    (r"我(?:不喜欢|讨厌|不想|拒绝)\s*(.+)", "aversion"),
    (r"(?:i (?:like|love|prefer|enjoy))\s+(.+)", "preference"),
    (r"(?:i (?:don't like|hate|dislike|avoid))\s+(.+)", "aversion"),
    (r"(?:请?记住|记一下|帮我记|remember)\s*[:：]?\s*(.+)", "explicit"),
    (r"我(?:在|住在|来自)\s*(.+)", "location"),
    (r"我(?:做|从事|工作是)\s*(.+)", "occupation"),
    (r"我(?:有|养了)\s*(.+)", "possession"),
    (r"我(?:想要|打算|计划|准备)\s*(.+)", "goal"),
    (r"(?:i (?:want to|plan to|intend to|need to))\s+(.+)", "goal"),
    (r"我(?:每天|通常|一般|经常|总是)\s*(.+)", "routine"),
    (r"(?:i (?:usually|always|often|every day))\s+(.+)", "routine"),
    (r"(?:今天|昨天|上周|最近)我?\s*(.{10,})", "event"),
    (r"我(?:认为|觉得|相信)\s*(.+)", "opinion"),
    (r"(?:i (?:think|believe|feel that))\s+(.+)", "opinion"),
)

# Keywords of each domain; earlier domains win ties.
DOMAIN_KEYWORDS = {
    "health": ("运动", "跑步", "健身", "睡眠", "失眠", "饮食", "体重", "医生", "药", "exercise", "sleep", "health", "diet", "workout", "doctor"),
    "work": ("工作", "公司", "项目", "会议", "同事", "老板", "加班", "deadline", "work", "project", "meeting", "office", "boss", "colleague"),
    "learning": ("学习", "课程", "考试", "读书", "教程", "知识", "learn", "study", "course", "exam", "book", "tutorial"),
    "finance": ("理财", "投资", "存款", "工资", "花费", "预算", "money", "invest", "budget", "salary", "saving"),
    "hobby": ("爱好", "游戏", "音乐", "电影", "旅行", "摄影", "画画", "hobby", "game", "music", "movie", "travel", "photo"),
}

# Statements about the speaker, and the relation they give.
TRIPLE_PATTERNS = (
    (r"我(?:叫|是)\s*(\S+)", "name_is"),
    (r"我在(.+?)(?:工作|上班)", "works_at"),
    (r"我(?:在|住在|来自)\s*(\S+)", "located_in"),
    (r"我(?:喜欢|爱)\s*(.+)", "likes"),
    (r"我(?:讨厌|不喜欢)\s*(.+)", "dislikes"),
    (r"我(?:有|养了)\s*(.+)", "has"),
    (r"我(?:正在|目前在)\s*(.+)", "currently_doing"),
)

# Profile patterns by facet, with the key they fill.
PROFILE_PATTERNS = {
    "who": (
        (r"我(?:叫|是|名字是)\s*(\S+)", "name"),
        (r"我在(.+?)(?:工作|上班|上学|实习)", "occupation"),
        (r"我(?:在|来自|住在)\s*(.+?)(?:[，。,.\s]|$)", "location"),
        (r"我(?:做|从事)\s*(.+?)(?:工作|的|$)", "occupation"),
        (r"我(?:今年|已经)?(\d+)岁", "age"),
    ),
    "how": (
        (r"我(?:喜欢|偏好|倾向于)\s*(.+)", "preference"),
        (r"我(?:不喜欢|讨厌|避免)\s*(.+)", "aversion"),
        (r"我(?:习惯|通常|一般)\s*(.+)", "habit"),
    ),
    "what": (
        (r"我(?:想要|打算|计划)\s*(.+)", "goal"),
        (r"我(?:正在|目前在)\s*(.+)", "current_focus"),
        (r"我(?:关注|关心)\s*(.+)", "interest"),
    ),
}

# Patterns that keep a text from being shared, and pieces that are cut out of shared ones.
SHARING_PII = (
    (r"(?<!\d)1[3-9]\d{9}(?!\d)", "phone_cn"),
    (r"(?<!\d)\d{3}[-.]?\d{3}[-.]?\d{4}(?!\d)", "phone_us"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "email"),
    (r"\b\d{15,18}[Xx]?\b", "id_card_cn"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "ssn_us"),
    (r"/(?:Users|home)/[^/\s]+", "file_path"),
    (r"(?:sk-|api[_-]?key[=:]\s*)[A-Za-z0-9_-]{20,}", "api_key"),
    (r"(?:password|passwd|pwd)[=:]\s*\S+", "password"),
)
STRIPPED = (r"\[(?:source|来源):?\s*\w+\]", r"~/[^\s]+", r"/Users/\w+/[^\s]+")

# Parts of a topic file's name and the domain they mean, first match counts.
TOPIC_DOMAINS = (
    ("ios", "ios"), ("swift", "ios"), ("swiftui", "ios"), ("rust", "rust"), ("cargo", "rust"), ("python", "python"), ("pip", "python"),
    ("3d", "3d"), ("blender", "3d"), ("game", "3d"), ("web", "web"), ("css", "web"), ("html", "web"), ("git", "devtools"), ("cli", "devtools"),
    ("npu", "hardware"), ("arm", "hardware"), ("network", "network"), ("proxy", "network"), ("dns", "network"),
)
# Domain names of imported documents.
DOMAIN_NAMES = {
    "ios": "ios", "swift": "ios", "swiftui": "ios", "3d": "3d", "blender": "3d", "rust": "rust", "python": "python", "shell": "devtools", "cli": "devtools",
}

_FLAGS, _FLAGS_NO_CASE = "(?dU)", "(?dUiu)"


def first_category(text: Column, rules: Sequence[tuple[str, str]] = GATE_PATTERNS) -> Column:
    """Category of the first rule that is found, case ignored; null if none is."""
    out = None
    for pattern, category in rules:
        hit = text.rlike(_FLAGS_NO_CASE + pattern)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out


def detect_domain(text: Column, keywords: dict[str, Sequence[str]] = DOMAIN_KEYWORDS) -> Column:
    """The domain with the most distinct keywords in the lower-case text; '' if it has none."""
    low = F.lower(text)
    scored = []
    for k, (name, words) in enumerate(keywords.items()):
        score = sum((low.contains(w).cast("int") for w in words), F.lit(0))
        scored.append(F.struct(score.alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, best["name"]).otherwise("")


def captures(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """array<struct<key, value>> of all rules that are found, each with its first hit, blank ones left out."""
    found = [F.struct(F.lit(key).alias("key"), strip(F.regexp_extract(text, _FLAGS + p, 1)).alias("value")) for p, key in rules]
    return F.filter(F.array(*found), lambda x: x["value"] != "")


def pii_hits(text: Column, rules: Sequence[tuple[str, str]] = SHARING_PII) -> Column:
    """array<struct<kind, value>> of all matches of all rules."""

    def hits(pattern: str, kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(_FLAGS + pattern), F.lit(0))
        return F.transform(found, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.concat(*[hits(p, kind) for p, kind in rules])


def has_pii(text: Column, rules: Sequence[tuple[str, str]] = SHARING_PII) -> Column:
    out = F.lit(False)
    for p, _ in rules:
        out = out | text.rlike(_FLAGS + p)
    return out


def scrub(text: Column) -> Column:
    """Without source tags and home paths, stripped."""
    for p in STRIPPED:
        text = F.regexp_replace(text, _FLAGS + p, "")
    return strip(text)


def training_scrub(text: Column) -> Column:
    """'' for a text with personal information, else its scrubbed form."""
    return F.when(has_pii(text), "").otherwise(scrub(text))


def contributor_hash(who: Column, salt: str = "engramlake") -> Column:
    """First 16 hex digits of the SHA-256 of ``who:salt``."""
    return F.substring(F.sha2(F.concat(who, F.lit(":" + salt)), 256), 1, 16)


def topic_domain(name: Column) -> Column:
    """Domain meant by a topic file's name, else 'general'."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(name), r"\.md", ""), "-", " ")
    out = None
    for part, domain in TOPIC_DOMAINS:
        out = F.when(clean.contains(part), domain) if out is None else out.when(clean.contains(part), domain)
    return out.otherwise("general")


def domain_name(raw: Column) -> Column:
    """Normalised domain of an imported document; empty or null is 'general'."""
    clean = strip(F.lower(raw))
    known = F.create_map(*[F.lit(x) for kv in DOMAIN_NAMES.items() for x in kv])
    return F.when(F.coalesce(raw, F.lit("")) == "", "general").otherwise(F.coalesce(known[clean], clean))
