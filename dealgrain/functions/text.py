"""Names, addresses, lot numbers and keys as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of names and addresses. Java's \s and [a-z] are ASCII-only here,
# and 가-힣 is the block of Hangul syllables.
BRACKETED = r"\([^)]*\)|\[[^\]]*\]"
APARTMENT_WORD = "아파트"
NOT_NAME_CHARACTER = r"[^0-9a-z가-힣]"
RURAL_PLACE = r"([0-9A-Za-z가-힣·.]+(?:읍|면)\s+[0-9A-Za-z가-힣·.]+리)(?:\s|$)"
ROAD_AND_NUMBER = r"([0-9A-Za-z가-힣·.]+(?:대로|로|길))\s+(\d+(?:-\d+)?)"
LAST_TWO_PARTS = r"^.*\|([^|]*\|[^|]*)$"
LOT_NUMBER = r"\d+(?:-\d+)?"
LOT_AFTER_PLACE = r"(?:동|가|읍|면|리)\s+(산\s*)?(\d+(?:-\d*)?)"
UP_TO_BUILDING = r"^(.+?(?:로|길)\s*\d+(?:-\d+)?)"
UP_TO_LOT = r"^(.+?(?:동|가|읍|면|리)\s+(?:산\s*)?\d+(?:-\d+)?)"
PLACE_ENDINGS = ["동", "읍", "면", "리"]
URL_COMPLEX = r"complex=(\d+)"
SUB_NUMBER = r"-\d+$"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def known(c: Column) -> Column:
    """Null for an empty text, so that joining it with others gives null too.

    The text is named once here; a conditional would repeat the whole expression at every level
    of nesting until the generated code no longer compiles.
    """
    return F.get(F.array_remove(F.array(c), ""), F.lit(0))


def squeeze(c: Column) -> Column:
    """Trim and collapse white space; empty for null."""
    return F.trim(F.regexp_replace(blank_if_null(c), r"\s+", " "))


def normalize_name(c: Column) -> Column:
    text = F.regexp_replace(F.lower(F.trim(blank_if_null(c))), BRACKETED, "")
    return F.regexp_replace(F.replace(text, F.lit(APARTMENT_WORD), F.lit("")), NOT_NAME_CHARACTER, "")


def normalize_address(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(blank_if_null(c))), NOT_NAME_CHARACTER, "")


def remove_spaces(c: Column) -> Column:
    return F.regexp_replace(blank_if_null(c), r"\s+", "")


def admin_dong(dong: Column, legal_address: Column | None = None) -> Column:
    """The dong, or township plus village where the legal address names them."""
    plain = normalize_address(dong)
    if legal_address is None:
        return plain
    rural = normalize_address(F.regexp_extract(squeeze(legal_address), RURAL_PLACE, 1))
    return F.coalesce(known(rural), plain)


def lot_number(c: Column) -> Column:
    """``[산]main[-sub]`` without leading zeros; a zero sub-number is dropped."""
    text = F.lower(F.trim(blank_if_null(c)))
    digits = F.regexp_replace(F.regexp_extract(text, LOT_NUMBER, 0), r"(^|-)0+(?=\d)", "$1")
    hill = F.when(text.startswith("산"), "산").otherwise("")
    return blank_if_null(F.concat(hill, known(F.regexp_replace(digits, r"-0$", ""))))


def road_number(main: Column, sub: Column | None = None) -> Column:
    """``main[-sub]`` of a building; empty without a main number."""
    head = F.regexp_replace(lot_number(main), r"-.*$", "")
    if sub is None:
        return head
    tail = F.regexp_replace(lot_number(sub), r"-.*$", "")
    return blank_if_null(F.concat(known(head), blank_if_null(F.concat(F.lit("-"), F.get(F.array_except(F.array(tail), F.array(F.lit(""), F.lit("0"))), F.lit(0))))))


def road_from_address(c: Column) -> tuple[Column, Column]:
    """Road name and building number found in a road address, empty when absent."""
    text = squeeze(c)
    road, number = (F.regexp_extract(text, ROAD_AND_NUMBER, i) for i in (1, 2))
    return normalize_address(road), lot_number(number)


def contract_road(road_name: Column, main: Column, sub: Column) -> tuple[Column, Column]:
    """Road name and number of a contract; separate number fields win over a number in the name."""
    road, number = road_from_address(road_name)
    return F.coalesce(known(road), normalize_address(road_name)), F.coalesce(known(road_number(main, sub)), number)


def joined_key(*parts: Column) -> Column:
    """Parts joined by ``|``; empty when any part is empty or null."""
    pieces = [known(p.cast("string")) for p in parts]
    spaced = [x for p in pieces for x in (F.lit("|"), p)][1:]
    return blank_if_null(F.concat(*spaced))


def without_sub_number(key: Column) -> Column:
    return F.regexp_replace(blank_if_null(key), SUB_NUMBER, "")


def region_code(c: Column) -> Column:
    """The first five-digit run, empty when there is none."""
    return F.regexp_extract(blank_if_null(c), r"(\d{5})", 1)


def padded_code(c: Column) -> Column:
    """A code filled with zeros up to five characters; longer codes are kept whole."""
    text = c.cast("string")
    return F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)


def road_key_in_region(code: Column, key: Column) -> Column:
    """A road key of any origin rewritten as ``code|road|number``."""
    return joined_key(code, F.regexp_extract(blank_if_null(key), LAST_TWO_PARTS, 1))


def lot_from_address(c: Column) -> Column:
    """The lot after the legal dong, with a hill mark; null when there is none."""
    text = squeeze(c)
    number = F.regexp_replace(F.regexp_extract(text, LOT_AFTER_PLACE, 2), r"-+$", "")
    hill = F.when(F.regexp_extract(text, LOT_AFTER_PLACE, 1) != "", "산").otherwise("")
    return F.concat(hill, known(number))


def dong_from_address(c: Column) -> Column:
    """The last word of an address that ends like a place name; null when there is none."""
    words = F.filter(
        F.split(squeeze(c), " "), lambda w: reduce(lambda a, b: a | b, [w.endswith(e) for e in PLACE_ENDINGS])
    )
    return F.when(F.size(words) > 0, F.element_at(words, -1))


def fallback_id(code: Column, dong: Column, lot: Column, name: Column) -> Column:
    """Stable id of a complex that is not in the register."""
    text = F.concat_ws("|", *[blank_if_null(c) for c in (code, dong, lot, name)])
    return F.concat(F.lit("TRADE_"), F.upper(F.substring(F.sha1(text), 1, 12)))


def contract_id(texts: list[Column], area: Column, floor: Column, deal_date: Column, amount: Column) -> Column:
    """Upper-case SHA-1 over the contract's identity.

    Numbers are written as whole numbers, the area in ten-thousandths, so the text never
    depends on how a double is printed.
    """
    whole = lambda c: F.round(c.cast("double")).cast("long")
    parts = [*texts, whole(area * 10_000), whole(floor), deal_date, whole(amount)]
    return F.upper(F.sha1(F.concat_ws("|", *[blank_if_null(p) for p in parts])))


def geocode_queries(road_address: Column, legal_address: Column) -> Column:
    """Address texts to look up, in order: whole, up to the building number, up to the lot."""
    variants = []
    for address in (squeeze(road_address), squeeze(legal_address)):
        variants.append(address)
        variants += [F.trim(F.regexp_extract(address, p, 1)) for p in (UP_TO_BUILDING, UP_TO_LOT)]
    return F.array_distinct(F.filter(F.array(*variants), lambda v: v != ""))


def url_complex_ids(c: Column) -> Column:
    return F.regexp_extract_all(blank_if_null(c), F.lit(URL_COMPLEX), F.lit(1))


def guard_formula(c: Column) -> Column:
    """Prefix an apostrophe where a spreadsheet would read the text as a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
