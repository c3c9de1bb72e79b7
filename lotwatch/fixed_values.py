"""Fixed values.

Word lists, patterns, thresholds and text formats that have to be exactly these
for results to agree with the procurement assistant whose operators this package
offers.  Every operator takes them as parameters; these are the defaults.
"""

# --- fixed values: relevance of a tender -----------------------------------
RELEVANT_CPV_PREFIXES = ["35", "18", "34711", "33"]
RELEVANT_KEYWORDS = [
    "дрон", "бпла", "квадрокоптер", "безпілотн",
    "тактичн", "військов", "бронежилет", "каска",
    "турнікет", "generator", "генератор",
]

# --- fixed values: supplier names that hide the real party ------------------
MASKED_SUPPLIERS = ["оборонний постачальник", "приховано"]

# --- fixed values: checked category prefixes --------------------------------
CPV_CATEGORIES = {
    "33": "medical equipment, medicines, pharmaceuticals",
    "18": "clothing, uniforms, workwear",
    "35": "security, fire and rescue equipment, electronic protection",
    "34": "transport, unmanned aerial vehicles, aircraft",
    "31": "generators, electrical equipment, batteries",
    "30": "office supplies, paper",
}

# --- fixed values: question routing -----------------------------------------
QUANTITATIVE_WORDS = [
    "скільки тендерів", "скільки закупівель", "скільки контрактів",
    "скільки всього", "скільки загалом",
    "кількість", "сумарн", "загальна сума", "загальний бюджет",
    "середн", "медіан", "максимальн", "мінімальн",
    "найдорожч", "найдешевш", "найчастіше", "топ ", "топ-", "рейтинг",
    "порівня", "відсот", "розподіл", "згрупу", "статистик",
    "хто", "постачальник", "конкуренція",
    "count(", "sum(", "avg(", "average", "median", "total", "how many",
]
QUALITATIVE_WORDS = ["характеристики", "вимоги", "опис", "технічні"]
QUALITATIVE_LEADING_WORDS = ["який ", "які "]
FOLLOWUP_MARKERS = [
    "чому це", "чому так", "чому?", "а це", "а той", "а всі",
    "той самий", "та сама", "ті самі", "це те саме",
    "саме цей", "саме ця", "саме ці", "саме той",
    "справді?", "точно?", "серйозно?",
    "is that the same", "is this the same", "same one", "same item",
    "why is that", "why is this", "why?",
]
INVESTIGATION_TRIGGERS = {
    "splitting": ["дроблен", "схем"],
    "monopoly": ["улюблен", "монопол"],
    "overpricing": ["найбільше переплатив", "переплатив за", "переплатила за", "переплата за"],
}

# --- fixed values: thresholds -----------------------------------------------
SPLITTING_LOW = 90000
SPLITTING_HIGH = 99999
SPLITTING_MIN_CONTRACTS = 3
REPORT_ROWS = 20
PREVIEW_ROWS = 30
MIN_FAIR_SAMPLE_SIZE = 3
PRICE_ANOMALY_RATIO = 1.3
RELEVANCE_THRESHOLD = 0.20
TOP_K = 5
EMBED_BATCH = 32
MESSAGE_LIMIT = 4096
MAX_TENDERS_PER_RUN = 2000
STALE_AFTER_HOURS = 30

# --- fixed values: patterns (Java regular expression syntax) ----------------
MARKDOWN_LINK = r"\[([^\]]*)\]\((?:https?://|www\.)[^)]*\)"
BARE_URL = r"\b(?:https?://|www\.)\S+"
ANY_MARKDOWN_LINK = r"\[([^\]]*)\]\(([^)]*)\)"
TENDER_NUMBER = r"\bUA-\d{4}-\d{2}-\d{2}-\d{6}-[A-Za-zА-Яа-яЇїІіЄєҐґ]\b"
MEASUREMENT = (
    r"(?iuU)\d[\d\s.,]*\s*(?:кг|км/год|км|м/с|м\b|грам\w*|г\.(?!рн)|метр\w*|"
    r"годин\w*|хвилин\w*|хв\.?|вт\b|ват\w*|вольт\w*)"
)

# --- fixed values: text formats ---------------------------------------------
NOT_STATED = "не вказано"
CONTEXT_SEPARATOR = "\n---\n"
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "
CHUNK_LINES = [
    "Тендер: {title}",
    "Номер: {tender_number}",
    "Замовник: {buyer_name} ({buyer_region}), тип замовника: {buyer_kind}",
    "Постачальник: {supplier_name}",
    "Категорія (CPV): {cpv_main} — {cpv_description}",
    "Орієнтовний бюджет: {budget_amount} {budget_currency}",
    "Сума контракту: {awarded_amount} {awarded_currency}",
    "Статус: {status}",
    "Метод закупівлі: {procurement_method_type}",
    "Дата створення: {date_created}",
]
CHUNK_DEFAULTS = {"budget_currency": "", "awarded_currency": ""}
EVIDENCE_LABEL = "📎 Тендери: "
MILLION_SUFFIX = " млн"
OR_EQUIVALENT = ["або еквівалент", "or equivalent"]
