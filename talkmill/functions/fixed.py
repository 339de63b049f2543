"""Word lists, tables and patterns that decide the results.

They are data, stated as text in natural order. Patterns are written without flags; the code
that uses them adds the Unicode flags Java needs.
"""

# Redaction tokens by kind.
PLACEHOLDERS = {
    "phone": "[ТЕЛЕФОН]",
    "email": "[EMAIL]",
    "contract": "[НОМЕР_ДОГОВОРА]",
    "digits": "[НОМЕР]",
    "ip": "[IP]",
    "url": "[ССЫЛКА]",
    "PER": "[ИМЯ]",
    "ORG": "[ОРГАНИЗАЦИЯ]",
    "LOC": "[АДРЕС]",
}

# Entity type of a span -> placeholder kind. Other types are left alone.
ENTITY_KINDS = {"PER": "PER", "PERSON": "PER", "ORG": "ORG", "LOC": "LOC", "GPE": "LOC"}

# Redaction patterns, as (placeholder kind, pattern, ignore case), in order. Repeated
# groups of words are possessive (`{2,}+`): what follows them can never start inside a repetition, so
# the matches are the same, and a long run of such words does not recurse.
DIGIT_WORDS = "ноль|один|два|три|четыре|пять|шесть|семь|восемь|девять"
CONTRACT_WORDS = (
    r"договор[а-я]*|контракт[а-я]*|тикет[а-я]*|заявк[аи]|обращени[ея]|номер|№|#\s*(?=\w)|\bid\b"
)
REDACTIONS = [
    ("url", r"https?://\S+|www\.\S+", False),
    ("email", r"[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z]{2,}", False),
    (
        "email",
        r"(?:[а-яёa-z](?:\s+(?:русская|латинская|заглавная|маленькая))?\s+){2,}+"
        r"(?:как\s+)?(?:собака|доллар|at|эт)(?:\s+[а-яёa-z]){1,}+(?:\s+точка\s+[а-яёa-z]{2,4})?",
        True,
    ),
    ("phone", r"(?:\+?7|8)[\s\-\(]*\d{3}[\s\-\)]*\d{3}[\s\-]*\d{2}[\s\-]*\d{2}", False),
    ("phone", r"\b(?:\d[\s\-]){6,}\d\b", False),
    ("phone", r"\b(?:(?:" + DIGIT_WORDS + r")[\s,\-]*){7,}+", True),
    ("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", False),
    ("contract", r"(?:" + CONTRACT_WORDS + r")\s*[A-ZА-ЯЁa-zа-яё]?[\d][\w\-\/]{2,}", True),
    ("digits", r"\b\d{8,}\b", False),
]

# Organisation named after a legal form, and after a trigger word.
ORG_LEGAL = (
    r"\b(?:ооо|оао|зао|пао|ип|ао|нко|фгуп|мкп|гбу|гуп)"
    r"\s+[«\"]?[А-ЯЁа-яё\w][\w\s\-«»\"]{1,40}[»\"]?"
)
ORG_TRIGGERS = (
    r"компани[яи]|компанию|фирм[аы]|фирму|организаци[яи]|организацию|предприяти[яе]|предприятию"
    r"|работодател[ьея]|заказчик[аи]?|поставщик[аи]?|подрядчик[аи]?|холдинг(?:е|а|у|ом)?|групп[аыу]"
)
ORG_NAME = r"[А-ЯЁ][А-ЯЁа-яё0-9\-]{1,30}(?:\s+[А-ЯЁа-яё0-9\-]{1,30}){0,3}"

# First names (nominative), male, female and short forms.
FIRST_NAMES = """
александр алексей андрей антон артём борис вадим валентин валерий василий виктор виталий
владимир владислав вячеслав геннадий георгий григорий даниил денис дмитрий евгений иван игорь
илья кирилл константин леонид максим михаил никита николай олег павел пётр роман руслан сергей
степан тимур фёдор филипп юрий яков ярослав
александра алина алла анастасия анна валентина валерия вера виктория галина дарья диана
екатерина елена жанна зинаида инна ирина карина кристина ксения лариса людмила маргарита марина
мария надежда наталья нина оксана ольга полина светлана софия тамара татьяна юлия
саша паша вася коля миша серёжа женя дима лена аня оля катя таня наташа юля маша света настя
даша лёша вова макс рома
""".split()

# Greeting and filler phrases, removed in this order.
NOISE_PHRASES = [
    r"\bдобрый\s+день\b",
    r"\bдоброе\s+утро\b",
    r"\bдобрый\s+вечер\b",
    r"\bздравствуйте\b",
    r"\bдобро\s+пожаловать\b",
    r"\bвы\s+позвонили\s+в\s+компанию\b",
    r"\bвы\s+дозвонились\b",
    r"\bслужба\s+(?:поддержки|технической\s+поддержки|клиентского\s+сервиса)\b",
    r"\bтехническая\s+поддержка\b",
    r"\bудобно\s+(?:вам\s+)?(?:сейчас\s+)?говорить\b",
    r"\bчем\s+могу\s+(?:вам\s+)?помочь\b",
    r"\bслушаю\s+(?:вас\b)?",
    r"\bслушаю\b",
    r"\bкак\s+могу\s+(?:вам\s+)?помочь\b",
    r"\bгот(?:ов|ова)\s+(?:вам\s+)?помочь\b",
    r"\bя\s+(?:вас\s+)?(?:понял|поняла|слышу|слышал[а]?)\b",
    r"\bпринято\b",
    r"\bхорошо\b",
    r"\bпонятно\b",
    r"\bконечно\b",
    r"\bнет\b(?:[,.]?\s+нет\b)*+",
    r"\bпожалуйста\b",
    r"\bподождите\s+(?:пожалуйста\s+)?(?:минуту|секунду|немного|одну\s+минуту)?\b",
    r"\bодну\s+(?:секунду|минуту)\b",
    r"\bпозвольте\s+уточнить\b",
    r"\bпроверяю\b",
    r"\bсмотрю\b",
    r"\bпередам\s+(?:ваше?\s+)?(?:обращение|вопрос|заявк[уи])\b",
    r"\bпередам\s+(?:вас|информацию|данные)\b",
    r"\bс\s+вами\s+свяжутся\b",
    r"\bс\s+вами\s+свяжется\s+(?:наш\s+)?(?:специалист|менеджер|сотрудник)\b",
    r"\bнаш\s+(?:специалист|менеджер|сотрудник)\s+(?:вам\s+)?(?:перезвонит|свяжется)\b",
    r"\bперезвоним\s+(?:вам\b)?",
    r"\bоставьте\s+(?:свои\s+)?данные\b",
    r"\bоставьте\s+(?:свой\s+)?(?:телефон|номер|email|почту)\b",
    r"\bвсего\s+(?:вам\s+)?доброго\b",
    r"\bвсего\s+хорошего\b",
    r"\bдо\s+свидания\b",
    r"\bдо\s+встречи\b",
    r"\bспасибо\s+за\s+(?:ваш\s+)?звонок\b",
    r"\bспасибо\s+за\s+обращение\b",
    r"\bспасибо\s+(?:вам\b)?",
    r"\bблагодарю\b",
    r"\bхорошего\s+(?:вам\s+)?дня\b",
    r"\bхорошего\s+вечера\b",
    r"\bваш\s+номер\s+телефона\b",
    r"\bваша?\s+(?:электронная\s+)?почта\b",
    r"\bдиктуйте\b",
    r"\bзаписываю\b",
    r"\bзаписал[а]?\b",
    r"\bмогу\s+(?:ли\s+)?(?:я\s+)?(?:ещё\s+)?чем-?(?:то|нибудь)\s+помочь\b",
    r"\bесть\s+(?:ещё\s+)?(?:какие-?(?:то|нибудь)\s+)?вопросы\b",
    r"\bесли\s+(?:у\s+вас\s+)?(?:будут\s+)?(?:ещё\s+)?вопросы\b",
    r"\bобращайтесь\b",
]

# Label aliases per column and labels that count as empty.
PRIORITY_ALIASES = {"high": "high", "medium": "medium", "low": "low"}
CALL_PURPOSE_ALIASES = {
    "consulting": "consulting",
    "cooperation": "cooperation",
    "courses": "courses",
    "customer_support": "customer_support",
    "general": "general",
    "hr": "hr",
    "license": "license",
    "ned": "need",
    "public_events": "public_events",
    "spam": "spam",
    "triage": "triage",
    "portal_access": "portal_access",
}
ASSIGNED_GROUP_ALIASES = {
    "education_center": "education_center",
    "general": "general",
    "hr_team": "hr_team",
    "sales": "sales",
    "consulting.general": "consulting.general",
    "consulting.greenplum": "consulting.greenplum",
    "consulting.hadoop": "consulting.hadoop",
    "cooperation_department": "cooperation_department",
    "customer_suppot.manager": "customer_support.manager",
    "customer.manager": "customer_support.manager",
    "marketing_department": "marketing_department",
    "portal_support": "portal_support",
    "public_events.conference": "public_events.conference",
}
EMPTY_LABELS = ["?", "-", "ge", ""]
EVAL_REMAP = {"escalation": "consulting", "marketing": "cooperation"}

# Transcript columns, and the columns kept in a ready data set.
TRANSCRIPT_COLUMNS = [
    "filename", "text", "is_training_sample", "call_purpose", "priority", "assigned_group",
]
READY_COLUMNS = ["filename", "text", "call_purpose", "priority", "assig_group"]

# Cells that a reader turns into the empty string.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Keyword flags.
COMMERCIAL_WORDS = (
    r"\b(?:стоимост[ьи]|цен[ауе]|прайс|лицензи[яию]|лицензирован\w+"
    r"|купить|приобрести|закупк[аи]|бюджет\w*|коммерческ\w+|предложени[яе]|прайс.?лист"
    r"|менеджер\w*\s+(?:по\s+)?продаж\w+|отдел\s+продаж|тендер\w*|договор\w*)\b"
)
TECHNICAL_WORDS = (
    r"\b(?:установ\w+|настро\w+|развернуть|деплой\w*|конфигур\w+"
    r"|ошибк[аи]|баг\w*|верси[яию]|кластер\w*|нод[аы]|питон|python|ansible|docker|linux|bash|shell"
    r"|adcm|adh|adpg|adb|арендата\s+дб|не\s+работает|не\s+запускается|не\s+подключается|упал\w*"
    r"|логи|дебаг\w*|трейс\w*|стектрейс\w*)\b"
)

# Yes-words of a synthetic flag; words that mean a missing answer; case files and
# their text fields; reference fields.
SYNTHETIC_WORDS = ["1", "true", "yes", "y", "synthetic", "синтетика"]
ABSENT_WORDS = ["null", "none", "n/a", "unknown"]
CASE_SUFFIXES = ["txt", "md", "text", "json"]
TEXT_FIELDS = ["text", "transcript", "content", "body", "message"]
REFERENCE_FIELDS = ["problem", "problem_keywords", "expected_problem"]

# Metric names that sort from high to low.
HIGH_IS_GOOD = [
    "f1", "f1_weighted", "accuracy", "precision", "precision_weighted", "recall",
    "recall_weighted",
]
