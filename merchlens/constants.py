"""Fixed values that must equal the reference's for identical results.

Everything below is a literal business constant (code lists, lookup tables,
thresholds, keyword rules).  They are kept together, in natural order, so a
reader can audit them against the reference behaviour in one place.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — acceptance methods (6 values)
# ---------------------------------------------------------------------------
ACCEPTANCE_METHODS = ["chip", "contactless", "online", "swipe", "mobile_pay", "keyed"]
DEFAULT_ACCEPTANCE = "chip"

# ---------------------------------------------------------------------------
# FIXED VALUES — three different valid-MCC lists, one per check (ledger L16)
# ---------------------------------------------------------------------------
# raw expectation suite (17 codes)
SUITE_VALID_MCC = [
    "5812", "5813", "5814", "5411", "5912", "7011",
    "5941", "5921", "5999", "7299", "7996", "4111",
    "5045", "5651", "5661", "5732", "5734",
]
# model tests on the raw source (12 codes)
MODEL_TEST_VALID_MCC = [
    "5812", "5813", "5814", "5411", "5912", "7011",
    "5941", "5921", "5999", "7299", "7996", "4111",
]
# per-record validation job (12 codes)
VALIDATION_VALID_MCC = [
    "5812", "5813", "5814", "5411", "5912", "7011",
    "5941", "5921", "5999", "7299", "7996", "4111",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — MCC -> description; 7011 appears several times in the source
# table, the last entry ("Hotels") wins.  Unknown codes -> "General Retail".
# ---------------------------------------------------------------------------
MCC_DESCRIPTIONS = {
    "5812": "Eating Places, Restaurants",
    "5813": "Drinking Places (Alcoholic Beverages) — Bars, Taverns, Cocktail Lounges",
    "5814": "Fast Food Restaurants",
    "5411": "Grocery Stores, Supermarkets",
    "5912": "Drug Stores, Pharmacies",
    "7011": "Hotels",
    "5941": "Sporting Goods Stores",
    "5921": "Package Stores — Beer, Wine, Liquor",
    "5999": "Miscellaneous and Specialty Retail Stores",
    "7299": "Services — Not Elsewhere Classified",
    "5734": "Computer and Computer Software Stores",
    "5651": "Family Clothing Stores",
    "5661": "Shoe Stores",
    "5732": "Electronics Stores",
    "7996": "Amusement Parks, Circuses, Carnivals",
    "4111": "Local/Suburban Commuter Transportation",
    "5045": "Computers, Peripherals, and Software",
}
DEFAULT_MCC_DESCRIPTION = "General Retail"

# ---------------------------------------------------------------------------
# FIXED VALUES — business category -> MCC (first category in list order wins;
# default 5812)
# ---------------------------------------------------------------------------
CATEGORY_TO_MCC = {
    "Restaurants": "5812",
    "Pizza": "5812",
    "Italian": "5812",
    "Burgers": "5812",
    "Mexican": "5812",
    "Japanese": "5812",
    "Sushi Bars": "5812",
    "Bars": "5813",
    "Cocktail Bars": "5813",
    "Breweries": "5813",
    "Wine Bars": "5813",
    "Fast Food": "5814",
    "Hot Dogs": "5814",
    "Grocery": "5411",
    "Hotels": "7011",
    "Gyms": "7299",
    "Coffee & Tea": "5812",
    "Cafes": "5812",
    "Bakeries": "5812",
    "Music Venues": "7996",
}
DEFAULT_MCC = "5812"

# ---------------------------------------------------------------------------
# FIXED VALUES — price tier -> expected amount (default 35); price default 2
# ---------------------------------------------------------------------------
PRICE_TO_AVG_TRANSACTION = {1: 15, 2: 35, 3: 75, 4: 150}
DEFAULT_PRICE_RANGE = 2
DEFAULT_EXPECTED_AMOUNT = 35

# ---------------------------------------------------------------------------
# FIXED VALUES — value tier thresholds: < 20 low, < 75 mid, else high
# ---------------------------------------------------------------------------
TIER_LOW_BELOW = 20
TIER_MID_BELOW = 75
VALUE_TIERS = ["low", "mid", "high"]
QUARTERS = ["Q1", "Q2", "Q3", "Q4"]

# ---------------------------------------------------------------------------
# FIXED VALUES — thresholds of the quality / freshness / anomaly jobs
# ---------------------------------------------------------------------------
AMOUNT_MIN, AMOUNT_MAX = 0.01, 99999.99          # validation + suites
STAGING_AMOUNT_CAP = 100000                      # staging filter: 0 < amount < cap
STARS_MIN, STARS_MAX = 1.0, 5.0
PRICE_MIN, PRICE_MAX = 1, 4
RAW_ROWCOUNT_MIN, RAW_ROWCOUNT_MAX = 1, 10_000_000
VALIDATION_PASS_RATE = 0.95
FRESHNESS_CRITICAL_DAYS = 7
FRESHNESS_WARNING_DAYS = 3
FRESHNESS_CRITICAL_SHARE = 0.1
ANOMALY_Z = 2.5
VELOCITY_SPIKE_MULT = 3.0
VELOCITY_SPIKE_FLOOR = 10
LOW_STAR_DEFAULT_SD = 0.5
ANALYTICS_FLAG_Z = 2.0
ANALYTICS_VELOCITY_RATIO = 2.5
Q4_PROXY_MULT = 1.3
MART_HIGH_VOLUME_SD = 2
MART_Q4_SPIKE_MULT = 1.5

# ---------------------------------------------------------------------------
# FIXED VALUES — retrieval and conversation parameters
# ---------------------------------------------------------------------------
CHUNK_BUDGETS = [256, 512, 1024]
DEFAULT_CHUNK_BUDGET = 512
DEFAULT_TOP_K = 5
TOKEN_PATTERN = "[a-z0-9]+"
CHUNK_PREVIEW_CHARS = 300
SEARCH_PREVIEW_CHARS = 150
TRACE_PREVIEW_CHARS = 200
MAX_TURNS = 10
HISTORY_TURNS = 3
HISTORY_ANSWER_CHARS = 300
QUESTION_MIN_CHARS, QUESTION_MAX_CHARS = 3, 500
TOP_K_MIN, TOP_K_MAX = 1, 20

# ---------------------------------------------------------------------------
# FIXED VALUES — keyword rules for filters inferred from question text, in the
# order they are tested (substring tests, ledger L15)
# ---------------------------------------------------------------------------
CITY_RULES = [
    (["chicago"], "Chicago"),
    (["new york", "nyc"], "New York"),
    (["los angeles", "la "], "Los Angeles"),
]
MCC_RULES = [
    (["restaurant", "dining", "food", "pizza", "burger"], "5812"),
    (["bar", "cocktail", "drink", "alcohol"], "5813"),
    (["fast food"], "5814"),
    (["hotel"], "7011"),
]
TIER_RULES = [
    (["cheap", "budget", "affordable"], "low"),
    (["expensive", "luxury", "upscale", "high-end"], "high"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — fallback answer text
# ---------------------------------------------------------------------------
NO_MATCH_ANSWER = (
    "No matching merchants found. "
    "Configure ANTHROPIC_API_KEY or OPENAI_API_KEY for AI-generated answers."
)

# ---------------------------------------------------------------------------
# FIXED VALUES — prompt template for the answer model (input text only; no model
# is called here) and the empty-history placeholder
# ---------------------------------------------------------------------------
RAG_PROMPT = (
    "Conversation history:\n{history}\n\n"
    "Retrieved merchant intelligence context:\n{context}\n\n"
    "Current question: {query}\n\n"
    "Answer using the merchant records above. Be specific, cite merchant names and data points."
)
NO_HISTORY = "No prior context."
