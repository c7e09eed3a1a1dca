"""Names, word lists, constants and bands the results depend on."""

# --- fixed values: issue kinds, actions, agents -------------------------------------------
ISSUE_KINDS = ["missing", "wrong_type", "formatting", "duplicate", "outlier", "category"]

ACTIONS = [
    "skip",
    "fill_missing",
    "remove_duplicate",
    "remove_outlier",
    "fix_category",
    "fix_type",
    "fix_formatting",
]

AGENTS = [
    "FillMissingAgent",
    "DuplicateDetector",
    "OutlierHandler",
    "CategoryStandardizer",
    "SkipAgent",
]

# --- fixed values: fills ------------------------------------------------------------------
FILL_DEFAULTS = {
    "age": 30,
    "salary": 60000,
    "score": 80,
    "name": "unknown",
    "email": "unknown@example.com",
    "dept": "unknown",
}
FILL_CONFIDENCE = {"age": 0.8, "salary": 0.8, "score": 0.8, "name": 0.6, "email": 0.6, "dept": 0.6}
FILL_CONFIDENCE_OTHER = 0.3

# --- fixed values: outliers ---------------------------------------------------------------
TYPICAL_QUARTILES = {"age": (25, 65), "salary": (40000, 120000), "score": (60, 95)}
TYPICAL_MEDIANS = {"age": 35, "salary": 75000, "score": 80}
# column -> (low, high) of the 0.9 band, (low, high) of the 0.7 band; 0.5 otherwise
OUTLIER_BANDS = {
    "age": ((10, 80), (18, 70)),
    "salary": ((20000, 200000), (35000, 150000)),
    "score": ((0, 100), (40, 95)),
}
RANGE_LOW, RANGE_HIGH, RANGE_REPLACEMENT = 0, 200000, 70000

# --- fixed values: categories -------------------------------------------------------------
CATEGORY_MAP = {
    "eng": "Engineering",
    "engineering": "Engineering",
    "ENGINEERING": "Engineering",
    "hr": "HR",
    "h.r.": "HR",
    "H.R.": "HR",
    "finance": "Finance",
    "FINANCE": "Finance",
}
VALID_DEPTS = ["Engineering", "HR", "Finance"]
KNOWN_CATEGORIES = {
    "dept": ["engineering", "sales", "marketing", "hr", "finance"],
    "name": ["john", "jane", "bob", "alice", "charlie"],
    "email": ["gmail.com", "yahoo.com", "company.com"],
}
FUZZY_THRESHOLD = 0.7
# fixed values: column and value of the action that a learned policy names
POLICY_TARGETS = {
    "skip": ("id", None),
    "fill_missing": ("age", "30"),
    "remove_duplicate": ("id", None),
    "remove_outlier": ("age", "35"),
    "fix_category": ("dept", "engineering"),
    "fix_type": ("score", None),
    "fix_formatting": ("email", None),
}

# --- fixed values: rewards ----------------------------------------------------------------
STEP_REWARDS = {  # action -> (reward when it took effect, reward when it did not)
    "fill_missing": (0.3, -0.1),
    "fix_type": (0.2, -0.1),
    "remove_duplicate": (0.4, -0.2),
    "fix_category": (0.3, -0.1),
    "remove_outlier": (0.4, -0.1),
    "fix_formatting": (0.2, -0.1),
    "skip": (-0.2, -0.2),
}
STEP_REWARD_UNKNOWN = -0.3
BASE_REWARDS = {
    "fill_missing": 0.3,
    "remove_duplicate": 0.35,
    "remove_outlier": 0.3,
    "fix_category": 0.3,
    "fix_type": 0.25,
    "fix_formatting": 0.25,
    "skip": -0.15,
}
COMPLETION_BONUS = [(0.9, 0.5), (0.8, 0.3), (0.7, 0.2), (0.6, 0.1)]
HISTORY_LENGTH = 100
CONTRADICTION_LOOKBACK = 5

# --- fixed values: missing-value tokens of the usual CSV readers ----------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: people table and error injection -----------------------------------------
NAME_OPTIONS = ["John", "Jane", "Bob", "Alice", "Charlie", "Diana", "Eve", "Frank"]
DEPT_OPTIONS = ["engineering", "sales", "marketing", "hr", "finance"]
EMAIL_DOMAINS = ["gmail.com", "yahoo.com", "company.com", "outlook.com"]
SALARY_RANGES = {
    "engineering": (60000, 150000),
    "sales": (40000, 120000),
    "marketing": (50000, 110000),
    "hr": (45000, 90000),
    "finance": (55000, 130000),
}
DEPT_TYPOS = {
    "engineering": "enginering",
    "sales": "salse",
    "marketing": "marketting",
    "hr": "h.r",
    "finance": "financ",
}
OUTLIER_VALUES = {"age": [5, 95, 120], "salary": [15000, 500000], "score": [-10, 150]}
NULLABLE_COLUMNS = ["age", "salary", "score", "name", "email"]
DIRT_LEVELS = {
    "easy": {"missing": 0.2, "duplicate": 0.0, "outlier": 0.0, "category": 0.0, "type": 0.05, "formatting": 0.0},
    "medium": {"missing": 0.3, "duplicate": 0.15, "outlier": 0.0, "category": 0.0, "type": 0.05, "formatting": 0.05},
    "hard": {"missing": 0.3, "duplicate": 0.15, "outlier": 0.1, "category": 0.2, "type": 0.05, "formatting": 0.1},
}

# --- fixed values: observation encoding -----------------------------------------------------
OBSERVED_NUMERIC = ["age", "salary", "score"]
OBSERVED_TEXT = ["dept", "name", "email"]
OBSERVED_ISSUES = [
    "missing:age", "missing:salary", "missing:score", "missing:name",
    "duplicate:row", "outlier:age", "outlier:salary", "outlier:score",
    "category:dept", "formatting:email", "formatting:name", "wrong_type:score",
]
STATE_SIZE = 50

# characters that Python's str.strip() removes
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
