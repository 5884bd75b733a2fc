"""Fixed values.

Every constant below must equal the behaviour being reproduced for results
to match (word lists, lookup tables, thresholds, boosts, patterns).  They are
stated plainly and in their natural order; nothing in the library derives
them any other way.
"""

from __future__ import annotations

# --- Synonym pairs (canonical head first) ----------------------------------
SYNONYM_PAIRS: list[tuple[str, str]] = [
    ("soy", "soya"),
    ("yogurt", "yoghurt"),
    ("color", "colour"),
    ("flavor", "flavour"),
    ("fillet", "filet"),
    ("zucchini", "courgette"),
    ("eggplant", "aubergine"),
]

# --- Static entity sets -----------------------------------------------------
ALLERGENS = ["gluten", "lactose", "peanuts", "nuts", "soy", "eggs", "dairy", "milk", "wheat"]
SUSTAINABILITY_LABELS = ["organic", "bio", "fair trade", "rainforest alliance", "non-gmo", "green"]
NUTRITION_TERMS = ["protein", "sugar", "sodium", "salt", "fat", "carbs", "carbohydrates", "energy", "calories"]
COUNTRIES = ["canada", "usa", "us", "uk", "france", "germany", "vermont"]

# Entity kinds in lookup precedence order (lower rank wins).
ENTITY_KINDS = [
    "brands",
    "categories",
    "ingredients",
    "allergens",
    "sustainability_labels",
    "nutrition",
    "countries",
]
# Output buckets of the entity extractor, "products" is always empty.
ENTITY_BUCKETS = ["products"] + ENTITY_KINDS

# --- Dictionary build -------------------------------------------------------
DICTIONARY_TOP = {"brands": 12000, "categories": 6000, "ingredients": 15000}
ALWAYS_INCLUDE_INGREDIENTS = [
    "blueberries", "milk", "butter", "oats", "bread", "coffee", "chips", "tomatoes",
    "peanut butter", "cheese", "honey", "sugar", "salt", "wheat", "soy", "almond",
]
DICTIONARY_PIECE_MAX_LEN = 48
DICTIONARY_NULL_WORDS = ["null", "none", "nan"]
FACET_TOP = 10000

# --- Nutrient names used by numeric filters and graders --------------------
NUTRIENT_FIELD_MAP: dict[str, str] = {
    "protein": "proteins",
    "proteins": "proteins",
    "sugar": "sugars",
    "sugars": "sugars",
    "fat": "fat",
    "calories": "energy-kcal",
    "kcal": "energy-kcal",
    "energy": "energy-kcal",
    "sodium": "sodium",
    "salt": "salt",
    "carbs": "carbohydrates",
    "carbohydrates": "carbohydrates",
    "fiber": "fiber",
    "saturated fat": "saturated-fat",
}

# --- Dietary flag thresholds (per 100 g) ------------------------------------
HIGH_PROTEIN_MIN = 10.0
LOW_SUGAR_MAX = 5.0
LOW_SODIUM_MAX = 0.12
MISSING_NUTRIENT = -1.0

FLAG_NAMES = [
    "is_organic", "is_vegan", "is_vegetarian", "is_palm_oil_free", "is_high_protein",
    "is_low_sugar", "is_low_sodium", "is_gluten_free", "is_lactose_free",
]

# --- Phrase annotation patterns ---------------------------------------------
MODIFIER_PATTERN = r"\b(?:fresh|frozen|raw|pure|natural|wild|farmed|salted|unsalted)\b"

NUMERIC_PATTERNS: list[tuple[str, str]] = [
    (r"\b(?:under|less than|<|<=)\s*(\d+(?:\.\d+)?)\s*(g|mg|kcal|calories)(?:\s+([a-zA-Z]+))?\b", "lte"),
    (r"\b(?:at least|more than|>|>=|over)\s*(\d+(?:\.\d+)?)\s*(g|mg|kcal|calories)(?:\s+([a-zA-Z]+))?\b", "gte"),
]

RECIPE_QTY_PATTERN = (
    r"\b(\d+(?:\.\d+)?|\d+/\d+)\s*(ml|milliliters?|millilitres?|l|liters?|litres?|cups?|tbsp|tablespoons?|tsp"
    r"|teaspoons?|grams?|g|kg|kilograms?|oz|ounces?|lbs?|pounds?|cloves?|slices?|cans?|pkgs?|packages?|pinch)\b"
)

# (pattern, filter key, value, explanation), evaluated in this order.
DIETARY_PATTERNS: list[tuple[str, str, bool, str]] = [
    (r"\b(?:organic|bio)\b", "organic", True,
     "Matched 'organic' or 'bio' keyword indicating organic certification"),
    (r"\bvegan\b", "vegan", True, "Matched 'vegan' keyword indicating vegan requirement"),
    (r"\b(?:vegetarian|veggie)\b", "vegetarian", True,
     "Matched 'vegetarian' or 'veggie' keyword indicating vegetarian requirement"),
    (r"\b(?:no[- ]palm[- ]oil|palm[- ]oil[- ]free|without[- ]palm[- ]oil|free[- ]of[- ]palm[- ]oil)\b",
     "palm_oil", False, "Matched phrase indicating palm oil exclusion"),
    (r"\b(?:palm[- ]oil)\b", "palm_oil", True, "Matched 'palm oil' keyword"),
    (r"\b(?:high[- ]protein|protein[- ]rich|rich[- ]in[- ]protein|extra[- ]protein)\b", "high_protein", True,
     "Matched phrase indicating high protein requirement"),
    (r"\b(?:low[- ]sugar|sugar[- ]free|zero[- ]sugar|no[- ]sugar|without[- ]sugar|less[- ]sugar)\b",
     "low_sugar", True, "Matched phrase indicating low or zero sugar requirement"),
    (r"\b(?:low[- ]sodium|sodium[- ]free|salt[- ]free|no[- ]salt|low[- ]salt|no[- ]sodium|without[- ]sodium"
     r"|less[- ]sodium)\b", "low_sodium", True,
     "Matched phrase indicating low or zero sodium/salt requirement"),
    (r"\b(?:gluten[- ]free|no[- ]gluten|without[- ]gluten|free[- ]of[- ]gluten)\b", "gluten_free", True,
     "Matched phrase indicating gluten-free requirement"),
    (r"\b(?:lactose[- ]free|dairy[- ]free|no[- ]lactose|without[- ]lactose|free[- ]of[- ]lactose)\b",
     "lactose_free", True, "Matched phrase indicating lactose-free requirement"),
]
FILTER_KEYS = ["organic", "vegan", "vegetarian", "palm_oil", "high_protein", "low_sugar", "low_sodium",
               "gluten_free", "lactose_free"]
# constraint key -> document flag
CONSTRAINT_TO_FLAG = {
    "organic": "is_organic",
    "vegan": "is_vegan",
    "vegetarian": "is_vegetarian",
    "high_protein": "is_high_protein",
    "low_sugar": "is_low_sugar",
    "low_sodium": "is_low_sodium",
    "gluten_free": "is_gluten_free",
    "lactose_free": "is_lactose_free",
}

BRAND_INTENT_PATTERNS = [r"\b(?:brand|by brand|brands)\b", r"\bshow me (?:.+) products\b", r"\bproducts by (?:.+)\b"]
CATEGORY_INTENT_PATTERN = r"\b(?:category|categories|under category|in category)\b"
INGREDIENT_INTENT_PATTERN = r"\b(?:ingredient|ingredients|made of|contains)\b"
EXPLICIT_BRAND_PATTERNS = [r"\bshow me (.+) products\b", r"\bproducts by (.+)\b", r"\b(?:brand|by brand) (.+)\b"]

NORMALIZATION_STEPS = ["lowercase", "punctuation_removal", "whitespace_collapse", "synonym_canonicalization"]
DEFAULT_PAGE_SIZE = 20
MAX_NGRAM = 4

# --- Ranking ----------------------------------------------------------------
FIELD_BOOSTS = {"product_name": 3.0, "brand": 2.0, "category": 1.5, "ingredients": 1.2, "search_text": 1.0}
PHRASE_BOOST = 10.0
AND_MATCH_BOOST = 5.0
FUZZY_BOOST = 0.5
MODIFIER_BOOST = 2.0
COMPLETENESS_WEIGHT = 0.15
PALM_OIL_FREE_BOOST = 2.0
# Offline tiered scorer: phrase tiers, token multiplier, all-token bonus, modifier bonus.
TIER_PHRASE = {"product_name": 30.0, "brand": 20.0, "category": 15.0, "search_text": 10.0}
TOKEN_MULTIPLIER = 2.0
ALL_TOKENS_BONUS = 5.0
MODIFIER_NAME_BONUS = 5.0
BM25_K1 = 1.2
BM25_B = 0.75
EXACT_VALUE_MAX_LEN = 256
EDGE_NGRAM_MIN = 2
EDGE_NGRAM_MAX = 20
AUTOCOMPLETE_SIZE = 5
EVAL_K = 10
