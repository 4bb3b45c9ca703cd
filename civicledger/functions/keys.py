"""Identity keys: business-number prefixes, vendor, entity and person names, and cleaning of raw fields.

All are Column expressions, so they stay in generated code and can be pushed below joins and aggregations.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes that vendor names lose, as many as three at the end.
VENDOR_SUFFIXES = ["INC", "LTD", "LLP", "LLC", "CORP", "CORPORATION", "LIMITED", "INCORPORATED", "CO", "COMPANY", "GP", "LP", "SRL", "LTEE", "SA", "NV", "BV", "GMBH", "PLC"]
# Vendor families, the first that matches wins.
VENDOR_FAMILIES = [
    ("DELOITTE", "^(DELOITTE|SAMSON BELAIR.*DELOITTE)"),
    ("MICROSOFT", "^MICROSOFT($| )"),
    ("COFOMO", "^COFOMO( OTTAWA)?$"),
    ("IBM", "^(IBM|INTERNATIONAL BUSINESS MACHINES)($| )"),
    ("KPMG", "^KPMG($| )"),
    ("PWC", "^(PWC|PRICEWATERHOUSECOOPERS|PRICE WATERHOUSE COOPERS)($| )"),
    ("ERNST AND YOUNG", "^(ERNST AND YOUNG|EY)($| )"),
    ("ACCENTURE", "^ACCENTURE($| )"),
    ("CGI", "^(CGI|CONSEILLERS EN GESTION ET INFORMATIQUE)($| )"),
    ("BELL CANADA", "^BELL( CANADA| MOBILITY| MEDIA| SOLUTIONS)"),
    ("TELUS", "^TELUS($| )"),
    ("ROGERS", "^ROGERS( COMMUNICATIONS| MEDIA| WIRELESS)?"),
    ("SNC-LAVALIN", "^(SNC LAVALIN|SNCLAVALIN|SNC-LAVALIN)"),
]
# Suffixes that entity names lose, however many.
ENTITY_SUFFIXES = ["LIMITED", "LIMITEE", "LTD", "LTEE", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LLP", "LLC", "PLC", "SOCIETY", "ASSOCIATION", "FOUNDATION"]
# The one suffix that the near-duplicate key drops.
STRIP_SUFFIXES = ["INC", "INCORPORATED", "LTD", "LTEE", "LIMITED", "LIMITEE", "CORP", "CORPORATION", "LLC", "LLP", "ULC", "CO", "COMPANY", "GROUP", "GROUPE", "HOLDINGS", "CANADA", "CDA", "CDN", "GP", "LP"]
ACCENTED, PLAIN = "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÑÇ", "AAAAAAEEEEIIIIOOOOOUUUUNC"


def bn_prefix(bn: Column) -> Column:
    """The nine characters that identify an entity; null of shorter numbers."""
    return F.when(F.length(F.trim(bn)) >= 9, F.substring(F.trim(bn), 1, 9))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def _family(v: Column) -> Column:
    """The vendor's family, or itself; most vendors are in none, which one pattern tells."""
    none = ~v.rlike("|".join(f"(?:{pattern})" for _, pattern in VENDOR_FAMILIES))
    return reduce(lambda c, rule: c.when(v.rlike(rule[1]), F.lit(rule[0])), VENDOR_FAMILIES, F.when(none, v))


def normalize_vendor(name: Column) -> Column:
    """Upper case, words only, without legal suffixes, families under one name; null of blank names."""
    v = F.trim(F.regexp_replace(F.replace(F.upper(F.trim(name)), F.lit("&"), F.lit(" AND ")), r"[^A-Z0-9]+", " "))
    v = F.trim(F.regexp_replace(v, rf"( ({'|'.join(VENDOR_SUFFIXES)})){{1,3}}$", ""))
    return F.when(F.trim(name) != "", _let(v, _family))


def normalize_entity(name: Column) -> Column:
    """Upper case, no accents, no punctuation, no legal suffix; for exact matching of names."""
    s = F.translate(F.upper(name), ACCENTED, PLAIN)
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[\p{Punct}]", " "), r"\s+", " "))
    return F.regexp_replace(s, rf"( ({'|'.join(ENTITY_SUFFIXES)}))+$", "")


def strip_key(name: Column) -> Column:
    """A key that near-duplicate vendor names share: one suffix dropped, letters and digits only."""
    s = F.regexp_replace(F.upper(name), rf"\s+({'|'.join(STRIP_SUFFIXES)})\.?\s*$", "")
    return F.regexp_replace(s, "[^A-Z0-9]", "")


def person_key(first: Column, last: Column, initials: Column) -> Column:
    return F.concat(F.lower(F.trim(first)), F.lit("|"), F.lower(F.trim(last)), F.lit("|"), F.coalesce(F.upper(F.trim(initials)), F.lit("")))


def bn_guess(text: Column) -> Column:
    """The first free-standing run of nine digits, or null."""
    return F.nullif(F.regexp_extract(text, r"\b(\d{9})\b", 1), F.lit(""))


def clean_money(raw: Column) -> Column:
    """The number that a money string begins with once $, commas and spaces are gone, or null."""
    digits = F.regexp_extract(F.regexp_replace(raw, r"[$,\s]", ""), r"^[-+]?(\d+\.?\d*|\.\d+)", 0)
    return F.nullif(digits, F.lit("")).try_cast("decimal(38,6)")


def clean_null(raw: Column) -> Column:
    """Null for the tokens that sources write for it."""
    return F.when(~F.coalesce(raw, F.lit("")).isin("", "None", "null"), raw)


def clean_date(raw: Column) -> Column:
    """A date from ISO or month/day/year text, or null."""
    s = F.trim(raw)
    iso = F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.substring(s, 1, 10).try_cast("date")
    us = F.regexp_replace(s, r"^(\d{1,2})/(\d{1,2})/(\d{4}).*$", "$3-$1-$2").try_cast("date")
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), iso).when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), us)


def english_half(text: Column) -> Column:
    """The English part of "English | French"."""
    return F.trim(F.split_part(text, F.lit("|"), F.lit(1)))


def match_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def effective_value(value: Column, original: Column, amendment: Column) -> Column:
    """The contract's value: as stated, else original plus amendment, else whichever is there."""
    return F.coalesce(value, original + amendment, original, amendment)


def amendment_ratio(original: Column, amendment: Column) -> Column:
    return F.when(original > 0, amendment / original)


def same_letters(text: Column) -> Column:
    """A key for joins and groups that is equal for texts that differ in case and accents only, in all of Unicode:
    composed and decomposed letters, and those that no list of replacements names."""
    return F.collate(text, "UNICODE_CI_AI")


def numbered_fields(record: Column) -> Column:
    """Of a JSON record, the fields whose names are numbers of three or four digits, as JSON by name; null if there are none."""
    fields = F.filter(F.map_entries(F.from_json(record, "map<string,string>")), lambda e: e["key"].rlike(r"^\d{3,4}$"))
    fields = F.array_sort(fields, lambda a, b: a["key"].cast("int") - b["key"].cast("int"))
    return F.when(F.size(fields) > 0, F.to_json(F.map_from_entries(fields)))
