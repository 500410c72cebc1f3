"""Names, patterns, labels and thresholds that results depend on."""

# --- fixed values: column roles by name, first match wins -------------------------
COLUMN_NAME_PATTERNS = {
    "id": r"(?i)(\b|_)(id|identifier|key)(\b|_)",
    "date": r"(?i)(\b|_)(date|time|timestamp|dt|day|month|year)(\b|_)",
    "price": r"(?i)(\b|_)(price|cost|amount|value|salary|income|spend|budget|balance)(\b|_)",
    "quantity": r"(?i)(\b|_)(quantity|qty|count|number|units|rooms|population|households)(\b|_)",
    "rating": r"(?i)(\b|_)(rating|score|satisfaction|quality|performance|review)(\b|_)",
    "duration": r"(?i)(\b|_)(duration|time|period|days|hours|seconds|minutes)(\b|_)",
    "location": r"(?i)(\b|_)(location|address|city|country|latitude|longitude|geo)(\b|_)",
    "stage": r"(?i)(\b|_)(stage|phase|status|step|level|progress)(\b|_)",
    "method": r"(?i)(\b|_)(method|channel|type|category|device|browser|source)(\b|_)",
    "text": r"(?i)(\b|_)(name|text|description|title|comment|label|audience)(\b|_)",
}

# --- fixed values: text that looks like a date, matched at the start ---------------
DATE_TEXT_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}-\d{2}-\d{4}",
    r"\d{4}/\d{2}/\d{2}",
]

# --- fixed values: class labels of the generated columns ---------------------------
TIER = ["Low", "Medium", "High", "Premium"]
QUANTILE_SEGMENT = ["Bottom 25%", "Lower Middle", "Upper Middle", "Top 25%"]
STD_CATEGORY = ["Very Low", "Low", "Average", "High", "Very High"]
THIRDS = ["Low", "Medium", "High"]
QUARTERS = ["Low", "Medium", "High", "Very High"]
PERCENTILE_SEGMENT = ["Minimal", "Low", "Moderate", "High", "Extensive"]
STOCK_LEVEL = ["Low Stock", "Adequate", "Excess"]
RATING_SATISFACTION = ["Poor", "Fair", "Good", "Excellent"]
RATING_NAMES = {1: "Poor", 2: "Fair", 3: "Good", 4: "Good", 5: "Excellent"}
TREND = ["Decreasing", "Stable", "Increasing"]
RECENCY = ["Very Recent", "Recent", "Older", "Historical"]
RECENCY_EDGES = [0.0, 30.0, 90.0, 180.0, float("inf")]
TEXT_LENGTH = ["Short", "Medium", "Long"]
LOCATION_ZONE = ["Central", "Midrange", "Peripheral"]
VALUE_SEGMENT = ["Low Value", "Medium Value", "High Value", "Premium"]
STDDEV_SEGMENT = ["Low", "Below Average", "Above Average", "High"]
BEHAVIOR_SEGMENT = ["Infrequent", "Occasional", "Regular", "Frequent"]
LIFECYCLE = {
    ("Recent", "High"): "Active High Value",
    ("Recent", "Low"): "Active Low Value",
    ("Old", "High"): "Lapsed High Value",
    ("Old", "Low"): "Lapsed Low Value",
}
PRICE_STRATEGY = ["Budget", "Value", "Standard", "Premium", "Luxury"]
FITTED_STOCK_LEVEL = ["Critical", "Low", "Adequate", "Excess"]
SATISFACTION = ["Very Dissatisfied", "Dissatisfied", "Neutral", "Satisfied", "Very Satisfied"]
FIVE_POINT_EDGES = [0.0, 1.5, 2.5, 3.5, 4.5, 5.0]
TEN_POINT_EDGES = [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]
NPS = ["Detractor", "Passive", "Promoter"]
NPS_EDGES = [0.0, 6.0, 8.0, 10.0]

# --- fixed values: words in a column name that give it a role -----------------------
VALUE_WORDS = ["income", "revenue", "sales", "profit", "price", "spend", "cost", "value"]
BEHAVIOR_WORDS = ["frequency", "recency", "duration", "visits", "orders", "purchases"]
STOCK_WORDS = ["stock", "inventory", "qty"]
FITTED_PRICE_WORDS = ["price", "cost", "value"]
FITTED_STOCK_WORDS = ["quantity", "count", "stock"]
FITTED_QUANTITY_WORDS = ["quantity", "qty", "count"]
FITTED_RATING_WORDS = ["rating", "score", "satisfaction"]
DATE_WORDS = ["date", "time"]

# --- fixed values: readers -----------------------------------------------------------
SEPARATORS = [",", ";", "\t", "|", " "]
COUNTED_SEPARATORS = [",", ";", "\t", "|"]
PREVIEW_LINES = 100
PREVIEW_CHARS = 100_000

# --- fixed values: use-case proposals -------------------------------------------------
PROPOSAL_DEFAULTS = {
    "title": "AI Use Case",
    "description": "Description not provided",
    "target_variable": "Unknown",
    "model_type": "auto",
    "business_value": "Not specified",
    "use_case_implementation_complexity": "medium",
    "prediction_interpretation": (
        "Predictions should be interpreted in the context of the business problem "
        "and validated by domain experts."
    ),
}
WHOLE_TEXT_TITLE = "AI Use Case Proposal"
MODEL_TYPES = ["classification", "regression", "clustering", "sentiment_analysis"]
UUID_PATTERN = r"(?i)^\{?(urn:uuid:)?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"

# --- fixed values: patterns in proposal texts (letter case is ignored, "." takes in line ends where noted) ---
PROPOSAL_JSON = r"\[\s*\{.*\}\s*\]"                                                # over line ends
PROPOSAL_INTRO = r"^(.*?)(?=\b(?:Use Case|AI Use Case|Proposal|Title)\b)"           # over line ends
PROPOSAL_START = r"(?:\n|^)(?:Use Case|AI Use Case|Proposal)(?:\s*\d+)?(?:\s*[:–-])?\s*(.*?)(?=\n|$)"
PROPOSAL_NUMBER = r"\n\s*\d+[\.\)]\s+"
PROPOSAL_GAP = r"\n\n\n+"
PROPOSAL_TITLE = r"(?:Title|Use Case|AI Use Case)(?:\s*\d+)?(?:\s*[:–-])?\s*(.*?)(?=\n|$)"
PROPOSAL_TARGET = r"TARGET_VARIABLE:\s*([^\n]+)"
PROPOSAL_MODEL = r"MODEL_TYPE:\s*([^\n]+)"
PROPOSAL_KPIS = r"\b(?:KPIs?|Key\s+Performance\s+Indicators?)\b"
PROPOSAL_KPI = r"(?:^|\n)\s*(?:\d+\.|\-|\*|\•)\s*(.*?)(?=\n\s*(?:\d+\.|\-|\*|\•)|$)"    # over line ends
PROPOSAL_TARGET_LINE = r"^TARGET_VARIABLE:.*$"                                       # of every line
PROPOSAL_MODEL_LINE = r"^MODEL_TYPE:.*$"                                             # of every line
BOLD = r"\*\*(.*?)\*\*"
FENCE_START = r"```\w*\n"
FENCE = r"```"
IDENTIFIER = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b"
