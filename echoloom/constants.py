"""Enums, word lists, patterns, thresholds and factors.

They define the results, so they are stated here once, as plain text, in natural order.
"""

# --- enums -----------------------------------------------------------------------------
FEEDBACK_TYPES = ["bug", "feature_request", "ux", "pricing", "docs", "performance", "security", "integration", "other"]
SEVERITY_LEVELS = ["critical", "high", "medium", "low", "minimal"]
COMPONENTS = [
    "authentication", "ui", "api", "database", "payment", "notifications", "search", "dashboard",
    "settings", "mobile", "desktop", "integration", "security", "performance", "other",
]
PRIORITY_LEVELS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "minimal": 1}
TICKET_STATUSES = ["open", "in_progress", "resolved", "closed", "wont_fix", "duplicate"]
TICKET_PLATFORMS = ["jira", "github", "linear", "asana"]
DONE_STATUSES = ["resolved", "closed"]
AGENTS = ["ingestor", "normalizer", "classifier", "clusterer", "prioritizer", "actioner", "digestor", "feedback_loop"]
REPORT_TYPES = ["hourly", "daily", "weekly", "monthly", "executive", "technical"]

# --- personal data patterns ------------------------------------------------------------
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONES = [
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"\b\(\d{3}\)\s*\d{3}[-.]?\d{4}\b",
    r"\b\+1[-.]?\d{3}[-.]?\d{3}[-.]?\d{4}\b",
]
CARD = r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"
SSN = r"\b\d{3}-?\d{2}-?\d{4}\b"
NAMES = [
    r"\b(?:Mr|Mrs|Ms|Dr)\.?\s+[A-Z][a-z]+\s+[A-Z][a-z]+\b",
    r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
]
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
URL = r'https?://[^\s<>"{}|\\^`\[\]]+'

# --- language detection ----------------------------------------------------------------
COMMON_WORDS = {
    "en": ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"],
    "es": ["el", "la", "de", "que", "y", "a", "en", "un", "es", "se", "no", "te", "lo", "le"],
    "fr": ["le", "de", "et", "à", "un", "il", "être", "en", "avoir", "que", "pour", "dans"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "dem", "mit", "sich", "nicht"],
    "it": ["il", "di", "che", "e", "la", "per", "con", "un", "in", "da", "del", "della", "dei"],
    "pt": ["o", "de", "e", "do", "da", "em", "um", "para", "com", "não", "uma", "os", "as"],
}
VOWEL_SHARES = {
    "en": {"a": 0.08, "e": 0.13, "i": 0.07, "o": 0.08, "u": 0.03},
    "es": {"a": 0.12, "e": 0.14, "i": 0.06, "o": 0.09, "u": 0.05},
    "fr": {"a": 0.08, "e": 0.15, "i": 0.07, "o": 0.05, "u": 0.06},
    "de": {"a": 0.07, "e": 0.16, "i": 0.08, "o": 0.03, "u": 0.05},
}
DOMAIN_LANGUAGES = {
    ".com": "en", ".org": "en", ".net": "en", ".co.uk": "en",
    ".fr": "fr", ".de": "de", ".es": "es", ".it": "it", ".pt": "pt",
}

# --- reply normalisation: first rule with a contained word wins --------------------------
TYPE_RULES = [
    ("bug", ["bug", "error", "issue"]),
    ("feature_request", ["feature", "request", "enhancement"]),
    ("ux", ["ux", "ui", "interface", "design"]),
    ("pricing", ["price", "cost", "billing"]),
    ("docs", ["doc", "help", "guide"]),
    ("performance", ["performance", "speed", "slow"]),
    ("security", ["security", "secure", "vulnerability"]),
    ("integration", ["integration", "api", "connect"]),
]
SEVERITY_RULES = [
    ("critical", ["critical", "urgent", "emergency"]),
    ("high", ["high", "important"]),
    ("medium", ["medium", "normal", "moderate"]),
    ("low", ["low", "minor"]),
    ("minimal", ["minimal", "trivial"]),
]
COMPONENT_RULES = [
    ("authentication", ["auth", "login", "password"]),
    ("ui", ["ui", "interface", "frontend"]),
    ("api", ["api", "endpoint"]),
    ("database", ["database", "db", "data"]),
    ("payment", ["payment", "billing", "checkout"]),
    ("notifications", ["notification", "alert", "email"]),
    ("search", ["search", "find"]),
    ("dashboard", ["dashboard", "home"]),
    ("settings", ["setting", "config", "preference"]),
    ("mobile", ["mobile", "phone", "app"]),
    ("desktop", ["desktop", "pc"]),
    ("integration", ["integration", "connect"]),
    ("security", ["security", "secure"]),
    ("performance", ["performance", "speed"]),
]

# --- scoring ---------------------------------------------------------------------------
WEIGHTS = {"severity": 0.35, "reach": 0.25, "recency": 0.20, "persona": 0.20}
SEVERITY_SCORES = {"critical": 1.0, "high": 0.8, "medium": 0.6, "low": 0.4, "minimal": 0.2}
REACH_STEPS = [(0, 0.0), (1, 0.1), (10, 0.3), (50, 0.5), (100, 0.7), (500, 0.8)]
REACH_TOP = 0.9
RECENCY_STEPS = [(1, 1.0), (24, 0.9), (72, 0.7), (168, 0.5), (720, 0.3)]
RECENCY_OLD = 0.1
SEGMENT_REACH = {"enterprise": 1.5, "professional": 1.2, "individual": 1.0, "trial": 0.8, "unknown": 0.9}
SEGMENT_PERSONA = {"enterprise": 0.9, "professional": 0.7, "individual": 0.5, "trial": 0.3, "unknown": 0.4}
SEGMENT_WORDS = [
    ("enterprise", ["enterprise", "corp", "company", "business"]),
    ("professional", ["pro", "professional", "team"]),
    ("trial", ["trial", "test", "demo"]),
]
QUALITY_FACTORS = {"high": 1.2, "medium": 1.0, "low": 0.8}
VALUE_STEPS = [(10000, 1.3), (1000, 1.2), (100, 1.1)]
REACH_CRITICAL = ["authentication", "payment", "api", "core"]
REACH_CRITICAL_FACTOR = 1.3
REVENUE_COMPONENTS = ["authentication", "payment", "api", "database", "security", "core"]
REVENUE_FACTOR = 1.15
QUALITY_WORDS = [
    "steps to reproduce", "expected behavior", "actual behavior", "environment", "version", "browser",
    "os", "screenshot", "error message", "stack trace", "logs",
]
URGENCY_WORDS = [
    "urgent", "critical", "emergency", "asap", "immediately", "blocking", "can't work", "broken",
    "down", "failing", "crash", "error", "bug", "issue", "problem",
]
URGENCY_PATTERNS = [
    "can't.*work", "not.*working", "broken", "failing", "urgent.*need", "critical.*issue", "emergency.*fix",
]
URGENCY_STRONG = ["critical", "emergency", "blocking", "can't work"]
LEVEL_STEPS = [(0.9, "critical"), (0.7, "high"), (0.5, "medium"), (0.3, "low")]

# --- tickets ---------------------------------------------------------------------------
JIRA_STEPS = [(0.95, "blocker"), (0.85, "critical"), (0.75, "high"), (0.65, "medium"), (0.55, "low")]
GITHUB_STEPS = [(0.9, "highest"), (0.8, "high"), (0.7, "medium"), (0.6, "low")]
PRIORITY_SIGNS = {
    "lowest": "🔵", "low": "🟢", "medium": "🟡", "high": "🟠", "highest": "🔴", "critical": "🚨", "blocker": "💥",
}
JIRA_PRIORITIES = {
    "lowest": "Lowest", "low": "Low", "medium": "Medium", "high": "High",
    "highest": "Highest", "critical": "Critical", "blocker": "Blocker",
}
JIRA_ISSUE_TYPES = {
    "bug": "Bug", "task": "Task", "story": "Story", "epic": "Epic",
    "subtask": "Sub-task", "issue": "Bug", "enhancement": "Story",
}
STORY_POINTS = [(0.9, 8), (0.8, 5), (0.7, 3), (0.6, 2)]
TICKET_THRESHOLD = 0.7
TICKETS_PER_HOUR = 10
TICKETS_PER_DAY = 50

# --- product mention search ------------------------------------------------------------
MENTION_TERMS = ["feedback", "review", "bug", "issue", "feature", "complaint", "problem", "experience"]
WEB_TERMS = ["feedback", "review", "issue", "bug report", "feature request"]
EXCLUDED_DOMAINS = ["github.com", "hackernews.com", "reddit.com", "stackoverflow.com"]

# --- request limits per hour -----------------------------------------------------------
REQUEST_LIMITS = {"default": 100, "workflow": 10, "report": 20, "admin": 1000}
ALERT_COOLDOWN_SECONDS = 300
NOTIFICATIONS_PER_HOUR = 10
