"""Company names: tokens, similarity, equity and depositary-receipt screens, ratio parsing. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without identity (legal forms, share descriptions, places), descriptions that end a name, first words that
# prove nothing alone, spelled-out forms, and what is no common equity (by name, and more of it where the type is unknown).
STOP = [
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "COS", "LTD", "LIMITED", "PLC", "LLC", "LP", "L", "P", "SA", "S", "A", "NV", "N", "V", "AG", "SE", "AB", "AS", "ASA", "OYJ", "SPA", "BV",
    "THE", "OF", "AND", "DE", "DEL", "NEW", "OLD", "HOLDING", "HOLDINGS", "HLDGS", "HLDG", "GROUP", "GRP", "CLASS", "CL", "COM", "COMMON", "STOCK", "SHARES", "SHS", "SH", "ORD", "ORDINARY", "ADR", "ADS",
    "SPONSORED", "SPON", "DEPOSITARY", "DEPOSITORY", "REPSTG", "REP", "EACH", "UNSPONSORED", "PAR", "VALUE", "USD", "NPV", "REGISTERED",
    "NY", "MD", "NJ", "PA", "CA", "TX", "FL", "MN", "OH", "VA", "MA", "IL", "WA", "GA", "CT", "CAN", "BC", "ON", "IN", "B", "C", "I", "II", "III", "ET", "AL", "FKA", "DBA", "F", "STK", "UNIT", "UNITS", "WI",
]
TAIL = "\\b(SPONSORED|UNSPONSORED|AMERICAN DEPOSITARY|ADR|ADS|CLASS [A-Z]\\b|COMMON STOCK|ORDINARY SHARES|COM STK|COM UNIT|COMMON SHARES|SHARES OF BENEFICIAL).*$"
GENERIC = ["AMERICAN", "FIRST", "UNITED", "NATIONAL", "GENERAL", "INTERNATIONAL", "NORTH", "SOUTH", "WESTERN", "EASTERN", "PACIFIC", "ATLANTIC", "GLOBAL", "US", "NEW", "CAPITAL", "CENTRAL", "SOUTHERN", "NORTHERN", "COMMUNITY", "CITIZENS", "PEOPLES", "SECURITY", "GREAT", "DOVER"]
EXPAND = {
    "INTL": "INTERNATIONAL", "INTERNATL": "INTERNATIONAL", "SYS": "SYSTEMS", "TECH": "TECHNOLOGIES", "TECHS": "TECHNOLOGIES", "SVCS": "SERVICES", "SVC": "SERVICE", "MGMT": "MANAGEMENT", "MGT": "MANAGEMENT",
    "FINL": "FINANCIAL", "FIN": "FINANCIAL", "NATL": "NATIONAL", "CTR": "CENTER", "CTRS": "CENTERS", "INDS": "INDUSTRIES", "IND": "INDUSTRIES", "PHARMA": "PHARMACEUTICALS", "PPTYS": "PROPERTIES",
    "PPTY": "PROPERTY", "RLTY": "REALTY", "COMMUN": "COMMUNICATIONS", "COMMUNS": "COMMUNICATIONS", "ENTMT": "ENTERTAINMENT", "BANCORPORATION": "BANCORP", "BK": "BANK", "MTG": "MORTGAGE",
    "INVT": "INVESTMENT", "INVTS": "INVESTMENTS", "ELEC": "ELECTRIC", "LABS": "LABORATORIES", "LAB": "LABORATORIES", "MFG": "MANUFACTURING", "PRODS": "PRODUCTS", "PROD": "PRODUCTS", "RES": "RESOURCES",
    "ENGR": "ENGINEERING", "DEV": "DEVELOPMENT", "SOLUTNS": "SOLUTIONS", "ASSOC": "ASSOCIATES", "AMER": "AMERICA", "GEN": "GENERAL", "MED": "MEDICAL", "HLTH": "HEALTH", "HEALTHCARE": "HEALTH", "SEMICONDUCTR": "SEMICONDUCTOR",
}
NOT_EQUITY = "\\b(WTS?|WARRANTS?|WT\\d|RIGHTS?|RTS|UNITS?,? EACH CONSISTING|NOTES?|NTS|DEBENTURES?|DEB|SPARQS|PERQS|TRUPS|QUIPS|TOPRS|CAP SECS|TRUST PFD|SUBORDINATED|SR NT|SENIOR NT|SENIOR NOTES?|DUE \\d|\\d+(\\.\\d+)?\\s?%|ETF|ETN|ISHARES|PROSHARES|SPDR)\\b"
NOT_EQUITY_UNTYPED = "\\b(UNITS?|PFD|PREFERRED|PREF|SENIOR|FUND|INDEX|TRUST UNITS?|DEPOSITARY SHARES? EACH REPRESENTING)\\b"
EQUITY_TYPES = ["CS", "ADRC", "OS", "GDR", "NYRS"]
#: Similarity from which two names are taken for one company's.
MATCH = 0.6
NICE_RATIOS = [1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 16, 20, 24, 25, 30, 32, 40, 50, 60, 64, 80, 100, 120, 150, 200, 250, 300, 400, 500, 600, 800, 1000, 1500, 2000, 5000]


def tokens(name: Column) -> Column:
    """Significant words of a company name in capitals, in order: tails cut, abbreviations spelled out, stop words and single letters left
    out. Null or empty names have none."""
    up = F.replace(F.replace(F.upper(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" AND ")), F.lit("'"), F.lit(""))
    head = F.regexp_replace(up, TAIL, "")
    full = F.create_map(*[F.lit(x) for kv in EXPAND.items() for x in kv])
    words = F.regexp_extract_all(F.when(head == "", up).otherwise(head), F.lit("[A-Z0-9]+"), F.lit(0))
    words = F.transform(words, lambda w: F.coalesce(F.element_at(full, w), w))
    return F.filter(words, lambda w: ~w.isin(STOP) & ~w.rlike("^[A-Z]$"))


def _same_word(a: Column, b: Column) -> Column:
    """Equal, or one begins the other from three letters on."""
    return (a == b) | ((F.length(a) >= 3) & F.startswith(b, a)) | ((F.length(b) >= 3) & F.startswith(a, b))


def similarity(a: Column, b: Column) -> Column:
    """The share of the shorter name's words that the longer one has.

    1 where the joined words are equal or, from six letters on, one begins the other. 0 where the first words differ, but for names of
    two words or more that all match in another order; where a generic word alone is compared with a longer name; and without words.
    """
    ja, jb = F.array_join(a, ""), F.array_join(b, "")
    shorter = F.size(a) <= F.size(b)
    short, long_ = F.when(shorter, a).otherwise(b), F.when(shorter, b).otherwise(a)
    hits = F.size(F.filter(short, lambda u: F.exists(long_, lambda v: _same_word(u, v))))
    score = hits / F.greatest(F.size(short), F.lit(1))
    begins = (F.least(F.length(ja), F.length(jb)) >= 6) & (F.startswith(ja, jb) | F.startswith(jb, ja))
    reordered = (score == 1.0) & (F.size(short) >= 2)
    first = F.coalesce(_same_word(F.get(a, F.lit(0)), F.get(b, F.lit(0))), F.lit(False))
    generic = (F.size(short) == 1) & F.get(short, F.lit(0)).isin(GENERIC) & (F.size(long_) > 1)
    none = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    return F.when(none, 0.0).when((ja == jb) | begins, 1.0).when(~first & ~reordered, 0.0).when(generic, 0.0).otherwise(score)


def looks_equity(name: Column, ticker: Column, kind: Column) -> Column:
    """Not a when-issued symbol, and by name no warrant, right, note or fund; without an equity type no preferred, unit or index either."""
    up = F.upper(F.coalesce(name, F.lit("")))
    typed = F.coalesce(kind.isin(EQUITY_TYPES), F.lit(False))
    when_issued = F.coalesce(ticker.rlike("[a-z]$"), F.lit(False))
    return ~when_issued & ~up.rlike(NOT_EQUITY) & (typed | ~up.rlike(NOT_EQUITY_UNTYPED))


def is_adr(name: Column, kind: Column) -> Column:
    return F.coalesce(kind.startswith("ADR"), F.lit(False)) | F.coalesce(name.rlike("(?i)american depositar|\\bADS\\b|\\bADRs?\\b|depositary (?:shares?|receipts?)"), F.lit(False))


_NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "eight": 8, "ten": 10, "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "one hundred": 100}
_WORDS = {"half": 0.5, "one-half": 0.5, "one-third": 1 / 3, "one-fourth": 0.25, "one-quarter": 0.25, "one-fifth": 0.2, "one-tenth": 0.1, "one-twentieth": 0.05, "one-hundredth": 0.01}


def adr_ratio(name: Column) -> Column:
    """Ordinary shares per receipt read from a name: "each representing two", "1/10", "0.5", "one-half of"; null if none."""
    text = F.lower(name)
    part = F.regexp_extract(text, "(?:represent(?:ing|s)?|repstg|rep\\.?|equal to)\\s+(.*)$", 1)
    fraction = F.regexp_extract(part, "^([0-9]+)\\s*/\\s*([0-9]+)", 1).try_cast("double") / F.nullif(F.regexp_extract(part, "^([0-9]+)\\s*/\\s*([0-9]+)", 2).try_cast("double"), F.lit(0.0))
    number = F.regexp_extract(part, "^([0-9]*\\.?[0-9]+)", 1).try_cast("double")
    out = F.coalesce(fraction, number)
    for words in (_WORDS, _NUMBERS):
        for w, v in words.items():
            out = F.coalesce(out, F.when(part.rlike(f"^(?:an? )?{w}\\b(?!-)"), float(v)))
    return F.when(F.length(part) > 0, F.when(out > 0, out))


def snap(ratio: Column, tolerance: float = 0.12) -> Column:
    """The nearest ratio of the kind n or 1/n within the (log) tolerance, else null."""
    table = F.array(*[F.lit(float(n)) for n in NICE_RATIOS], *[F.lit(1.0 / n) for n in NICE_RATIOS[1:]])
    best = F.array_min(F.transform(table, lambda v: F.struct(F.abs(F.ln(ratio) - F.ln(v)).alias("d"), v.alias("v"))))
    return F.when((ratio > 0) & (best["d"] <= tolerance), best["v"])


def is_round(k: Column) -> Column:
    """Whether a split ratio is one that companies choose: n, 1/n, n/2, n/4 or so."""
    near = lambda x: F.abs(x - F.round(x)) < 1e-3
    return F.when(k > 0, near(k) | near(1 / k) | near(2 * k) | near(2 / k) | near(4 * k) | near(4 / k) | near(10 * k))
