"""Fixed values of the domain: word lists, state tables, scripts and default settings."""

from __future__ import annotations

from dataclasses import dataclass

# Texts that count as missing, compared stripped and lower-cased.
NULL_STRINGS = ["", "null", "nan", "none", "n/a", "na", "-", "--"]

# Texts that a delimited file's reader takes as missing, in any column.
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
]

# Dotted or spaced legal terms, in the order in which they are replaced (case-insensitive).
DOTTED_LEGAL = [
    (r"\bl\s*[\.\s]+\s*l\s*[\.\s]+\s*p\.?\b", "llp"),
    (r"\bl\s*[\.\s]+\s*l\s*[\.\s]+\s*c\.?\b", "llc"),
    (r"\bl\s*[\.\s]+\s*p\.?\b", "lp"),
    (r"\bp\s*[\.\s]+\s*v\s*[\.\s]+\s*t\.?\b", "pvt"),
    (r"\bpvt\.?\s+ltd\.?\b", "private limited"),
    (r"\bprivate\s+limited\b", "private limited"),
    (r"\bltd\.?\b", "ltd"),
    (r"\bcorp\.?\b", "corp"),
    (r"\binc\.?\b", "inc"),
]

# Domain endings that are cut from names, and the shorter list that marks a domain name.
DOMAIN_ENDING = r"\.(com|net|org|in|co\.in|biz|info|edu|gov|io|www)\b"
DOMAIN_NAME = r"\.(com|net|org|in|co\.in)\b"

# Canonical forms of legal words.  The looked-up token is folded first, so only folded spellings matter.
SUFFIX_CANON = {
    "corporation": "corp",
    "incorporated": "inc",
    "company": "co",
    "limited": "ltd",
    "and": "and",
    "&": "and",
    "associates": "assoc",
    "group": "group",
    "holdings": "holdings",
    "ventures": "ventures",
    "solutions": "solutions",
    "services": "services",
    "enterprises": "enterprises",
    "international": "intl",
    "technologies": "tech",
    "technology": "tech",
    "private": "pvt",
    "pvt": "pvt",
    "llp": "llp",
    "llc": "llc",
    "lp": "lp",
    "plc": "plc",
    "pllc": "llc",
    "praiveta": "pvt",
    "limiteda": "ltd",
    "elaelapi": "llp",
    "li": "",
    "pra": "",
}

# Legal words that are dropped from names.
SUFFIX_REMOVE = [
    "pvt", "ltd", "llc", "llp", "lp", "inc", "corp", "co", "plc", "pc", "assoc", "public", "partners", "foundation", "trust", "society",
]

# Digits that stand for letters in scanned names.
OCR_FROM, OCR_TO = "6051", "gosl"

# Words without meaning in an address.
ADDRESS_NOISE = [
    "unit", "floor", "flat", "no", "plot", "building", "block", "sector",
    "road", "street", "avenue", "drive", "lane", "near", "opp", "behind",
    "opposite", "rd", "st", "ave", "dr", "ln", "blvd", "hwy", "highway",
    "apt", "suite", "ste", "fl", "bldg", "dept", "po", "box", "pob",
    "and", "the", "of", "first", "second", "third", "ground",
    "upper", "lower", "main", "new", "old",
    "east", "west", "north", "south",
    "only", "null", "true", "false", "none", "na", "nil",
    "room", "rm", "apartment", "number",
]

# Words that come before a street number.
NUMBER_LABELS = ["no", "number", "plot", "flat", "unit", "suite", "ste", "apt", "apartment", "door"]

# States of the US by abbreviation.
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut",
    "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa",
    "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan",
    "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire",
    "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio",
    "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota",
    "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia",
    "wi": "wisconsin", "wy": "wyoming", "dc": "district of columbia",
}

# States and union territories of India by abbreviation.
INDIA_STATES = {
    "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh", "ga": "goa", "gj": "gujarat",
    "hr": "haryana", "hp": "himachal pradesh", "jh": "jharkhand", "ka": "karnataka", "kl": "kerala", "mp": "madhya pradesh",
    "mh": "maharashtra", "mn": "manipur", "ml": "meghalaya", "mz": "mizoram", "nl": "nagaland", "od": "odisha", "or": "odisha",
    "pb": "punjab", "rj": "rajasthan", "sk": "sikkim", "tn": "tamil nadu", "ts": "telangana", "tg": "telangana", "tr": "tripura",
    "up": "uttar pradesh", "uk": "uttarakhand", "ut": "uttarakhand", "wb": "west bengal", "an": "andaman and nicobar islands",
    "ch": "chandigarh", "dl": "delhi", "jk": "jammu and kashmir", "la": "ladakh", "ld": "lakshadweep", "py": "puducherry",
    "dn": "dadra and nagar haveli and daman and diu", "dd": "dadra and nagar haveli and daman and diu",
}

# Indian states in native scripts.
NATIVE_STATES = {
    "ఆంధ్రప్రదేశ్": "andhra pradesh",
    "आंध्र प्रदेश": "andhra pradesh",
    "अरुणाचल प्रदेश": "arunachal pradesh",
    "অসম": "assam",
    "বিহার": "bihar",
    "बिहार": "bihar",
    "छत्तीसगढ़": "chhattisgarh",
    "ગુજરાત": "gujarat",
    "हरियाणा": "haryana",
    "ਹਰਿਆਣਾ": "haryana",
    "हिमाचल प्रदेश": "himachal pradesh",
    "झारखंड": "jharkhand",
    "ಕರ್ನಾಟಕ": "karnataka",
    "കേരളം": "kerala",
    "मध्य प्रदेश": "madhya pradesh",
    "महाराष्ट्र": "maharashtra",
    "মণিপুর": "manipur",
    "ओडिशा": "odisha",
    "ଓଡ଼ିଶା": "odisha",
    "ਪੰਜਾਬ": "punjab",
    "पंजाब": "punjab",
    "राजस्थान": "rajasthan",
    "தமிழ்நாடு": "tamil nadu",
    "తెలంగాణ": "telangana",
    "त्रिपुरा": "tripura",
    "उत्तर प्रदेश": "uttar pradesh",
    "उत्तराखंड": "uttarakhand",
    "পশ্চিমবঙ্গ": "west bengal",
    "पश्चिम बंगाल": "west bengal",
    "दिल्ली": "delhi",
    "जम्मू और कश्मीर": "jammu and kashmir",
    "ਚੰਡੀਗੜ੍ਹ": "chandigarh",
    "लद्दाख": "ladakh",
    "पुदुच्चेरी": "puducherry",
}

# Unicode blocks of the Indic scripts; their order breaks ties.
SCRIPTS = {
    "devanagari": (0x0900, 0x097F),
    "bengali": (0x0980, 0x09FF),
    "gurmukhi": (0x0A00, 0x0A7F),
    "gujarati": (0x0A80, 0x0AFF),
    "oriya": (0x0B00, 0x0B7F),
    "tamil": (0x0B80, 0x0BFF),
    "telugu": (0x0C00, 0x0C7F),
    "kannada": (0x0C80, 0x0CFF),
    "malayalam": (0x0D00, 0x0D7F),
}

# Stop words of the token channel.
STOPWORDS = [
    "and", "the", "of", "in", "at", "for", "to", "a", "an",
    "india", "us", "new", "old", "main", "global", "services",
    "solutions", "group", "tech", "technologies", "international",
    "intl", "enterprises", "company", "limited", "pvt", "ltd",
    "llc", "llp", "inc", "corp", "co", "plc", "assoc",
    "store", "shop", "house", "center", "centre", "trading",
    "trade", "business", "system", "systems",
]

#: Channels from the strongest to the weakest evidence.
CHANNEL_PRIORITY = ["G", "A", "E", "C", "B", "D", "F"]


@dataclass(frozen=True)
class Config:
    """Settings of blocking; the defaults are the fixed values of the reference behaviour."""

    minhash_permutations: int = 64
    minhash_threshold: float = 0.25
    shingle: int = 3
    gram_low: int = 2
    gram_high: int = 4
    max_features: int = 65_536
    top_k: int = 15
    name_floor: float = 0.15
    address_floor: float = 0.12
    idf_floor: float = 2.0
    min_overlap: int = 1
    max_candidates: int = 80
    completeness_target: float = 0.90
