"""Thresholds, word lists, patterns and names that results depend on."""

# Branch fusion.
TEXT_WEIGHT_SUFFICIENT = 0.7
TEXT_WEIGHT_SPARSE = 0.3
SHORTLIST_LIMIT = 20
BRANCH_LIMIT = 10
PALETTE_WEIGHT = 0.05
NEUTRAL_PALETTE = 0.5

# Decision thresholds.
MIN_SCORE = 0.60
MIN_MARGIN = 0.03
MIN_GEOMETRY = 0.65
EXACT_IMAGE = 0.985
EXACT_GEOMETRY = 0.95
SUPPORT_GEOMETRY = 0.35
SUPPORT_IMAGE = 0.70

# Geometric verification of a photo pair.
MIN_MATCHES = 15
MIN_INLIERS = 12
MIN_INLIER_RATIO = 0.3

# Text label resolution.
LABEL_MIN_SIMILARITY = 0.90
LABEL_MIN_MARGIN = 0.015
LABEL_MIN_WORDS = 2
LABEL_MIN_LETTERS = 10

# Recognised-text sufficiency.
MIN_TEXT_WORDS = 3
MIN_INFORMATIVE_WORDS = 2
MIN_INFORMATIVE_LETTERS = 12
MIN_TEXT_CONFIDENCE = 0.75

# Words that cannot identify an item.
GENERIC_WORDS = (
    "вино винодельня винодельни семейная сухое сухой полусухое полусладкое сладкое белое красное "
    "розовое игристое брют россия wine winery dry red white rose brut since founded рублей цена руб "
    "литр мл alcohol alc vol"
).split()

# Lines and phrases that are never an item name.
GENERIC_LINES = (
    "вино винодельня згу знмп сухое полусухое полусладкое сладкое красное белое розовое брют brut"
).split()
GENERIC_PHRASES = ["российское вино", "семейная винодельня", "произведено", "на территории"]
REGULATORY_PREFIXES = ["згу ", "3гу ", "zgu ", "знмп "]
NAME_EDGE_CHARACTERS = " \t\r\n/|,.;:-_\"'()[]"

# Words beside a founding year.
FOUNDING_PATTERN = "основан|основания|since|founded|established"

# Latin characters and digits read in place of Cyrillic letters.
LOOKALIKE_FROM = "abcehkmoptxy360"
LOOKALIKE_TO = "авсенкмортхузбо"

# Letters without a single-letter transliteration.
TRANSLIT_MANY = {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}
# Letters with one, and letters that are dropped.
TRANSLIT_ONE_FROM = "абвгдеёзийклмнопрстуфхцыэ"
TRANSLIT_ONE_TO = "abvgdeezijklmnoprstufhcye"
TRANSLIT_DROPPED = "ъь"

# Photo file names.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff"]
UPLOAD_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp"]
VARIANT_PREFIX = "^(?i)(?:thumbnail|small|medium|large)_"
STORAGE_HASH = "_(?i)[0-9a-f]{10}$"
MAX_IMAGE_BYTES = 10 * 1024 * 1024

# Catalog columns, with the header spellings accepted on import.
CATALOG_FIELDS = ["name", "category", "color", "region", "grape_variety", "description", "winery"]
FIELD_ALIASES = {
    "name": ["название вина", "название", "name", "wine name"],
    "category": ["категория", "category"],
    "color": ["цвет", "color"],
    "region": ["регион", "region"],
    "grape_variety": ["сорт винограда", "сорта винограда", "grape variety", "grape_variety"],
    "description": ["описание", "description"],
    "winery": ["винодельня", "производитель", "winery", "producer"],
    "slug": ["slug", "слаг"],
    "dataset_photo": ["название фото", "фото", "dataset photo", "dataset_photo", "photo filename"],
}
# Passage labels of the seven attributes.
PASSAGE_LABELS = {
    "name": "Название",
    "category": "Категория",
    "color": "Цвет",
    "region": "Регион",
    "grape_variety": "Сорт винограда",
    "description": "Описание",
    "winery": "Винодельня",
}
# Source columns already shown as card fields.
KNOWN_CARD_LABELS = [
    "Slug", "Название фото", "Название вина", "Категория", "Цвет", "Регион", "Сорт винограда",
    "Описание", "Винодельня",
]

# Stored locations.
FEEDBACK_PREFIX = "/data/reference/feedback/"
CATALOG_PREFIX = "/data/reference/catalog/"
WEB_PHOTO_PREFIX = "/data/web_photos/"
WEB_REFERENCE_MARK = "/web-"

# Pages shown instead of a card.
CHALLENGE_MARKERS = [
    "captcha", "капча", "проверка что вы не робот", "подтвердите, что вы не робот", "доступ ограничен",
]
BLOCKED_STATUS = [401, 403]

# Limits and levels.
RECALL_LEVELS = (1, 5, 20)
MAX_ERROR_CHARS = 4000
MAX_REPORTED_PROBLEMS = 20
JOB_RETENTION_SECONDS = 3600
JOB_CAPACITY = 16
INDEX_FAILURE = "Reference indexing failed; submit feedback again to retry"

# Word, number, year, percentage and volume patterns.
TOKEN_PATTERN = r"[0-9]+(?:[.,][0-9]+)?%?|[a-zA-Zа-яА-ЯёЁ]+(?:[-'][a-zA-Zа-яА-ЯёЁ]+)?"
YEAR_PATTERN = r"(?<!\p{Nd})(?:19|20)\p{Nd}{2}(?!\p{Nd})"
PERCENT_PATTERN = r"(?<!\p{Nd})\p{Nd}{1,2}(?:[.,]\p{Nd}{1,2})?\s*%"
VOLUME_PATTERN = (
    r"(?<!\p{Nd})(?:0[.,]\p{Nd}{1,3}|[1-9]\p{Nd}{0,3}(?:[.,]\p{Nd}{1,3})?)\s*"
    r"(?iu:мл|ml|л|l|cl|сl)(?![a-zA-Zа-яА-ЯёЁ])"
)
WORD_PATTERN = "[a-zа-я]{3,}"
SLUG_PATTERN = "^[a-z0-9][a-z0-9_-]{0,299}$"
