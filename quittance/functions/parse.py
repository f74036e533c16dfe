"""Typed values from recognised text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that recognition mistakes for digits, and the digits.
MISREAD = ("lIoOSbGB", "11005668")

_FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_TIME = r"(?: \d{1,2}:\d{2}(?::\d{2})?)?"
_ISO = rf"^\s*(\d{{4}})[-./](\d{{1,2}})[-./](\d{{1,2}}){_TIME}\s*$"
_DAY = rf"^\s*(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}|\d{{2}}){_TIME}\s*$"
# What nearly all texts look like, and what is read without the general patterns.
_DIGITS_MARK_DIGITS = r"^\d+[.,]\d+$"
_FIRST_DIGITS = rf"^(\d+)(?![\d{MISREAD[0]}])"
_TWO_TWO_FOUR = r"^\d{2}[./-]\d{2}[./-][1-9]\d{3}$"
_INSIDE = r"\d{2}[./-]\d{2}[./-]\d{2,4}"
#: Two-digit years from here on are of the last century.
YEAR_PIVOT = 76


def _extract(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def repair_digits(text: Column) -> Column:
    return F.translate(text, *MISREAD)


def parse_price(text: Column) -> Column:
    """Price as a double: the last dot or comma is the decimal mark, and only the digits next to it count.

    Without a mark: the first run of digits, without sign, or null. With one: 0.0 where no number remains.
    """
    p = F.replace(repair_digits(text), F.lit(","), F.lit("."))
    clean = F.when(text.rlike(_DIGITS_MARK_DIGITS), F.replace(text, F.lit(","), F.lit("."))).try_cast("double")
    # other prices mostly have digits on both sides of the last mark, and need one pattern
    plain = F.regexp_extract(p, r"(?s)(-?\d+\.\d+)[^.]*$", 1).try_cast("double")
    whole = F.regexp_extract(p, r"(?s)^(.*)\.([^.]*)$", 1)
    part = F.regexp_extract(p, r"(?s)^(.*)\.([^.]*)$", 2)
    number = F.concat(F.coalesce(_extract(whole, r"-?\d+$"), whole), F.lit("."), F.coalesce(_extract(part, r"^\d+"), part))
    rest = F.when(F.instr(p, ".") == 0, _extract(p, r"\d+").try_cast("double")).otherwise(
        F.when(number.rlike(_FLOAT), F.trim(number).try_cast("double")).when(p.isNotNull(), F.lit(0.0))
    )
    return F.coalesce(clean, plain, rest)


def parse_price_strict(text: Column) -> Column:
    """Like parse_price, but keeps the sign, drops marks of thousands, and is null where no number remains."""
    p = F.regexp_extract(F.replace(repair_digits(text), F.lit(","), F.lit(".")), r"-?\d[\d.]*", 0)
    cut = F.regexp_replace(p, r"\.(?=.*\.)", "")
    return F.nullif(cut, F.lit("")).try_cast("double")


def parse_int(text: Column) -> Column:
    """The first run of digits, or null."""
    clean = _extract(text, _FIRST_DIGITS, 1).try_cast("bigint")
    return F.coalesce(clean, _extract(repair_digits(text), r"\d+").try_cast("bigint"))


def parse_date(text: Column, day_first: bool = False, year_pivot: int = YEAR_PIVOT) -> Column:
    """A date from the common numeric forms, or null; month first where both are possible, unless ``day_first``."""
    inside = _extract(text, _INSIDE)
    source = F.when(text.rlike(_DAY), text).when(F.length(inside).isin(8, 10), inside)
    a, b, y = (F.regexp_extract(source, _DAY, i).try_cast("int") for i in (1, 2, 3))
    year = F.when(y >= 1000, y).when(y >= year_pivot, y + 1900).otherwise(y + 2000)
    swap = (b <= 12) if day_first else (a > 12)
    month, day = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    numeric = F.concat_ws("-", year, month, day)
    iso = F.concat_ws("-", *[F.regexp_extract(text, _ISO, i).try_cast("int") for i in (1, 2, 3)])
    ymd = F.when(text.rlike(_ISO), iso).when(source.isNotNull(), numeric)
    # two digits compare as text like the numbers that they are
    d1, d2 = F.substring(text, 1, 2), F.substring(text, 4, 2)
    turned = (d2 <= "12") if day_first else (d1 > "12")
    clean = F.concat_ws("-", F.substring(text, 7, 4), F.when(turned, d2).otherwise(d1), F.when(turned, d1).otherwise(d2))
    return F.when(text.rlike(_TWO_TWO_FOUR), clean.try_cast("date")).otherwise(F.try_to_timestamp(ymd, F.lit("yyyy-M-d")).cast("date"))


def corrected(text: Column, fmt: Column) -> dict[str, Column]:
    """The typed value by the label's format: one of the three columns is set, and ``corrected_kind`` names it."""
    return {
        "corrected_date": F.when(fmt.isin("DATE", "DATETIME"), parse_date(text)),
        "corrected_num": F.when(fmt == "PRICE", parse_price(text)),
        "corrected_int": F.when(fmt == "NUMBER", parse_int(text)),
        "corrected_kind": F.when(fmt.isin("DATE", "DATETIME"), "date").when(fmt == "PRICE", "num").when(fmt == "NUMBER", "int"),
    }


def is_json(text: Column) -> Column:
    """Whether a string parses as JSON."""
    return F.try_parse_json(text).isNotNull()


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def pair_literal(text: Column, conf_milli: Column) -> Column:
    """('text', 0.987), quotes in the text escaped."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    number = F.when(
        conf_milli.between(0, 999_999), F.concat(F.floor(conf_milli / 1000).cast("string"), F.lit("."), F.lpad((conf_milli % 1000).cast("int").cast("string"), 3, "0"))
    ).otherwise(F.format_string("%d.%03d", F.floor(conf_milli / 1000).cast("int"), (conf_milli % 1000).cast("int")))
    return F.concat(F.lit("('"), escaped, F.lit("', "), number, F.lit(")"))
