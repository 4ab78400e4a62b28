"""Defaults, word lists, patterns, weights and column sets.

These decide the results, so they are stated as plain literals in one place.
"""

from __future__ import annotations

SESSION_TIMEOUT_SECONDS = 1800.0
ROOT_PATH = "/"
BOT, HUMAN, UNKNOWN = "bot", "human", "unknown"
LABELS = [BOT, HUMAN, UNKNOWN]
PREFIXES = [3, 5, 10, 15, 20]
HARD_PREFIXES = [3, 5, 10]
FULL_SESSION_PREFIX = -1
NO_PATH_HOPS = 999
FAR_JUMP_HOPS = 3
LOW_LATENCY_SECONDS = 1.0

ASSET_EXTENSIONS = [
    "css", "js", "mjs", "png", "jpg", "jpeg", "gif", "svg", "ico", "webp",
    "woff", "woff2", "ttf", "map", "json", "xml", "txt", "pdf", "zip", "gz",
]
NON_HTML_EXTENSIONS = [
    "xml", "txt", "json", "csv", "css", "js", "svg", "png", "jpg", "jpeg", "webp", "ico",
]
IGNORED_HREF_PREFIXES = ["mailto:", "tel:", "javascript:", "#"]

BOT_AGENT_PATTERNS = [
    "python-requests", "researchscraper", "researchstealth", "stealth-browser", "hybridcrawler",
    "browsernoise", "scrapy", "selenium", "webdriver", "playwright", "puppeteer", "aiohttp",
    "httpclient", "httpx", "curl/", "wget/", "urllib", "headless", "phantomjs", "go-http-client",
]
PREVIEW_AGENT_PATTERNS = [
    "bot", "crawler", "spider", "slurp", "google-read-aloud", "whatsapp", "facebookexternalhit",
    "discordbot", "slackbot", "telegrambot", "linkedinbot", "twitterbot",
]
BROWSER_TOKENS = ["mozilla/", "chrome/", "firefox/", "safari/", "edg/"]

# (family, pattern on the lower-cased agent), first match wins
AGENT_FAMILY_RULES = [
    ("python_requests", "python-requests"),
    ("playwright", "playwright"),
    ("selenium", "selenium|webdriver"),
    ("research_scraper", "researchscraper"),
    ("stealth_browser", "researchstealth|stealth-browser|hybridcrawler|browsernoise"),
]
BOT_FAMILY_RULES = [
    ("bfs", "bfs"),
    ("dfs", "dfs"),
    ("linear", "linear"),
    ("product_focus", "productfocus|products"),
    ("article_focus", "articlefocus|articles"),
    ("stealth_revisit", "researchstealth|stealth-browser|revisit"),
    ("browser_hybrid", "hybridcrawler|browser_hybrid"),
    ("browser_noise", "browsernoise|browser_noise"),
    ("playwright_browser", "playwright"),
    ("selenium_browser", "selenium|webdriver"),
    ("generic_requests", "python-requests|curl/|wget/|urllib|httpx|aiohttp"),
]

# canonical request column -> accepted source columns, first match wins, case ignored
REQUEST_COLUMN_ALIASES = {
    "timestamp": ["timestamp", "time", "ts", "@timestamp", "date", "datetime"],
    "path": ["path", "uri", "url", "request_uri", "request_path", "cs-uri-stem"],
    "method": ["method", "request_method", "http_method", "cs-method"],
    "status_code": ["status_code", "status", "sc-status"],
    "user_agent": ["user_agent", "http_user_agent", "agent", "cs-user-agent"],
    "referrer": ["referrer", "referer", "http_referer", "cs-referer"],
    "ip": ["ip", "client_ip", "remote_addr", "x_forwarded_for", "c-ip"],
    "cookie_id": ["cookie_id", "session_cookie", "cookie", "sessionid"],
    "client_id": ["client_id", "visitor_id", "device_id"],
    "label": ["label"],
}
REQUIRED_SESSION_REQUEST_COLUMNS = ["session_id", "timestamp", "path", "delta_t", "label"]

# ip - - [time] "METHOD path PROTOCOL" status bytes "referrer" "agent"
COMBINED_LOG_PATTERN = (
    r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+)(?: ([^"]+))?" (\d{3}) (\S+) "([^"]*)" "([^"]*)"$'
)
COMBINED_TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"

LABEL_METADATA = ["participant_id", "traffic_family", "collection_method", "automation_stack", "notes"]
LABEL_COLUMNS = ["client_key", "session_id", "label", *LABEL_METADATA]
TEMPLATE_COLUMNS = [
    "session_id", "client_key", "label", "participant_id", "traffic_family", "collection_method",
    "automation_stack", "notes", "num_events", "duration_seconds", "first_path", "start_timestamp",
    "user_agent", "proposed_label",
]

FEATURE_GROUPS = {
    "session": ["session_length_so_far"],
    "graph": [
        "unique_nodes", "unique_node_ratio", "revisit_ratio", "repeated_path_ratio",
        "repeated_transition_ratio", "backtrack_count", "self_loop_ratio", "mean_depth",
        "leaf_visit_ratio", "out_degree_mean", "mean_hop_distance", "far_jump_ratio",
        "category_switch_rate", "branching_concentration", "coverage_concentration",
        "transition_concentration", "category_concentration", "revisit_growth",
    ],
    "timing": [
        "mean_delta_t", "std_delta_t", "burstiness", "low_latency_ratio", "error_rate",
        "user_agent_switch_rate",
    ],
    "entropy": [
        "transition_entropy", "normalized_transition_entropy", "category_entropy",
        "normalized_category_entropy", "node_entropy", "normalized_node_entropy",
        "category_transition_entropy", "normalized_category_transition_entropy",
        "local_branching_entropy", "node_entropy_delta", "transition_entropy_delta",
        "category_entropy_delta", "category_transition_entropy_delta",
        "normalized_node_entropy_delta", "normalized_transition_entropy_delta",
        "normalized_category_entropy_delta", "normalized_category_transition_entropy_delta",
        "entropy_slope", "transition_entropy_slope", "category_transition_entropy_slope",
        "navigation_entropy_score", "navigation_entropy_score_v2",
    ],
}
ABLATIONS = {
    "all_features": ["session", "graph", "timing", "entropy"],
    "graph_plus_entropy": ["session", "graph", "entropy"],
    "graph_only": ["session", "graph"],
    "entropy_only": ["session", "entropy"],
    "timing_only": ["session", "timing"],
}
FEATURE_COLUMNS = [name for group in FEATURE_GROUPS.values() for name in group]

# score = sum(weight * term)
NAVIGATION_SCORE_WEIGHTS = {
    "normalized_transition_entropy": 0.30, "normalized_category_entropy": 0.20, "novelty": 0.15,
    "category_switch_rate": 0.15, "far_jump_ratio": 0.10, "steadiness": 0.10,
}
NAVIGATION_SCORE_V2_WEIGHTS = {
    "normalized_transition_entropy": 0.22, "normalized_node_entropy": 0.18,
    "normalized_category_transition_entropy": 0.18, "local_branching_entropy": 0.15,
    "transition_delta": 0.12, "spread": 0.08, "no_growth": 0.07,
}
RULE_SCORE_WEIGHTS = {
    "navigation_entropy_score": 0.28, "repeated_transition_ratio": 0.16, "low_latency_ratio": 0.17,
    "leaf_visit_ratio": 0.12, "far_jump_ratio": 0.08, "has_suspect_user_agent": 0.12,
    "ua_browser_like": 0.07,
}
WEAK_SCORE_STEPS = {
    "suspect_agent": 0.55, "fast": 0.20, "long": 0.10, "mostly_new": 0.10, "few_categories": 0.05,
}
WEAK_BOT_WITH_AGENT, WEAK_BOT_ALONE, WEAK_HUMAN = 0.55, 0.75, 0.15

STATIC_NUMERIC = [
    "has_suspect_user_agent", "ua_length", "ua_slash_count", "ua_browser_like",
    "first_path_depth", "first_status_code", "first_body_bytes_sent",
]
STATIC_CATEGORICAL = ["ua_family", "first_category", "first_method"]

NUMERIC_CUES = [
    "has_suspect_user_agent", "ua_browser_like", "referrer_present_ratio", "asset_request_ratio",
    "num_asset_requests", "num_page_requests", "num_events", "unique_paths", "mean_delta_t",
    "first_path_depth",
]
CATEGORICAL_CUES = [
    "ua_family", "first_path", "first_category", "collection_method", "automation_stack",
    "traffic_family",
]
FLAG_HIGH, FLAG_MEDIUM = 0.95, 0.85
MIN_CUE_SUPPORT = 3
CLASS_SUMMARY_METRICS = {
    "mean_num_events": "num_events", "mean_unique_paths": "unique_paths",
    "mean_referrer_present_ratio": "referrer_present_ratio",
    "mean_asset_request_ratio": "asset_request_ratio",
    "share_suspect_user_agent": "has_suspect_user_agent",
    "mean_navigation_entropy_score_v2": "navigation_entropy_score_v2",
}
TOP_VALUE_COLUMNS = ["ua_family", "traffic_family", "first_path"]
LEAKAGE_KEYS = ["session_id", "client_key", "path_signature", "prefix3_signature", "prefix5_signature"]
ENTROPY_VARIANTS = [
    "node_entropy", "normalized_node_entropy", "transition_entropy", "normalized_transition_entropy",
    "category_entropy", "normalized_category_entropy", "category_transition_entropy",
    "normalized_category_transition_entropy", "local_branching_entropy", "navigation_entropy_score",
    "navigation_entropy_score_v2", "normalized_node_entropy_delta",
    "normalized_transition_entropy_delta", "normalized_category_transition_entropy_delta",
    "entropy_slope", "transition_entropy_slope", "category_transition_entropy_slope",
]
PROTOCOLS = [
    "session_split", "hard_prefix_session_split", "leave_one_bot_family_out", "time_split",
    "leave_one_human_user_out",
]
HOLDOUT_ABLATIONS = ["all_features", "graph_plus_entropy", "entropy_only", "timing_only"]
SPLIT_SHARES = [("train", 0.60), ("val", 0.20), ("test", 0.20)]
