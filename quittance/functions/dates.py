"""Dates written with month names, in several languages, as Column functions and as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the months, lower case and without accents.
MONTHS = {
    1: ("january", "jan", "januar", "januari", "janvier", "janv", "enero", "ene", "gennaio", "gen", "janeiro"),
    2: ("february", "feb", "februar", "februari", "fevrier", "fevr", "febrero", "febbraio", "fevereiro", "fev"),
    3: ("march", "mar", "marz", "maerz", "maart", "mrt", "mars", "marzo", "marco"),
    4: ("april", "apr", "avril", "avr", "abril", "abr", "aprile"),
    5: ("may", "mai", "mei", "mayo", "maggio", "mag", "maio"),
    6: ("june", "jun", "juni", "juin", "junio", "giugno", "giu", "junho"),
    7: ("july", "jul", "juli", "juillet", "juil", "julio", "luglio", "lug", "julho"),
    8: ("august", "aug", "augustus", "aout", "agosto", "ago"),
    9: ("september", "sep", "sept", "septembre", "septiembre", "settembre", "set", "setembro"),
    10: ("october", "oct", "oktober", "okt", "octobre", "octubre", "ottobre", "ott", "outubro", "out"),
    11: ("november", "nov", "novembre", "noviembre", "novembro"),
    12: ("december", "dec", "dezember", "dez", "decembre", "diciembre", "dic", "dicembre", "dezembro"),
}
# Names of the days of the week, lower case and without accents.
WEEKDAYS = (
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "mon", "tue", "wed", "thu", "fri", "sat", "sun",
    "montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag", "maandag", "dinsdag", "woensdag", "donderdag", "vrijdag", "zaterdag", "zondag",
    "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche", "lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo",
)
# Letters with accents, and without.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûü", "aaaaaaceeeeiiiinooooouuuu")

_NAME = "|".join(sorted({n for names in MONTHS.values() for n in names}, key=lambda n: (-len(n), n)))
_DAYS = "|".join(sorted(WEEKDAYS, key=lambda n: (-len(n), n)))
_SEP = r"[ .,/-]*"
_START = r"(?:^|[^a-z0-9])"
_DAY = r"(\d{1,2})(?:st|nd|rd|th|er|e|o)?"
_OF = r"(?:of |de |del |den |the )?"
_MONTH = rf"({_NAME})"
_YEAR = r"'?(\d{4}|\d{2})"
_END = r"(?:$|[^a-z0-9])"
#: Forms in order of preference: the pattern, and which groups are year, month and day (0: not there).
FORMS = (
    (rf"{_START}(\d{{4}}){_SEP}{_MONTH}{_SEP}{_DAY}{_END}", (1, 2, 3)),
    (rf"{_START}{_DAY}{_SEP}{_OF}{_MONTH}{_SEP}{_OF}{_YEAR}{_END}", (3, 2, 1)),
    (rf"{_START}{_MONTH}\.? {_OF}{_DAY}(?:, ?| |, of ){_YEAR}{_END}", (3, 1, 2)),
    (rf"{_START}{_DAY}{_SEP}{_OF}{_MONTH}{_END}", (0, 2, 1)),
    (rf"{_START}{_MONTH}{_SEP}{_OF}(\d{{4}}){_END}", (2, 1, 0)),
    (rf"{_START}{_MONTH}\.? {_OF}{_DAY}{_END}", (0, 1, 2)),
)


def plain_text(text: Column) -> Column:
    """Lower case, without accents, white space to single spaces, days of the week gone."""
    low = F.translate(F.lower(text), *ACCENTS)
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[ \t\n\r]+", " "), rf"(^|[^a-z])(?:{_DAYS})(?:[.,]+|(?=[^a-z]|$))", "$1"))


def parse_written_date(text: Column, default_year: Column | int | None = None, year_pivot: int = 76) -> Column:
    """(date, precision) of the first written date in a text, null where there is none.

    Months are names or abbreviations in English, German, Dutch, French,
    Spanish, Italian and Portuguese; days may have an ordinal ending, and days
    of the week are skipped. A date is "day" if all is said; with day and month
    only it takes ``default_year`` and is "day of year", null without one; with
    month and year it is the first of the month, and "month". Days that the
    month does not have give null.
    """
    months = F.create_map(*[x for m, names in MONTHS.items() for n in names for x in (F.lit(n), F.lit(m))])
    default = F.lit(default_year).cast("int") if default_year is None or isinstance(default_year, int) else default_year.cast("int")

    def parts(t: Column) -> Column:
        """What the first form that fits says of year, month and day, as text."""
        found = F.lit(None).cast("struct<y:string,m:string,d:string,precision:string>")
        for pattern, (y, m, d) in reversed(FORMS):
            of = lambda g, p=pattern: F.regexp_extract(t, p, g) if g else F.lit(None).cast("string")
            kind = "day" if y and d else "day of year" if d else "month"
            found = F.when(t.rlike(pattern), F.struct(of(y).alias("y"), of(m).alias("m"), of(d).alias("d"), F.lit(kind).alias("precision"))).otherwise(found)
        return found

    def dated(p: Column) -> Column:
        said = p["y"].try_cast("int")
        year = F.when(p["y"].isNull(), default).when(said >= 100, said).when(said >= year_pivot, said + 1900).otherwise(said + 2000)
        day = F.coalesce(p["d"], F.lit("1")).try_cast("int")
        ymd = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.try_element_at(months, p["m"]).cast("string"), F.lit("-"), day.cast("string"))
        return F.struct(F.try_to_timestamp(ymd, F.lit("yyyy-M-d")).cast("date").alias("date"), p["precision"].alias("precision"))

    return _with(_with(_with(plain_text(text), parts), dated), lambda r: F.when(r["date"].isNotNull(), r))


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def written_date_sql(text: str, default_year: str = "NULL", year_pivot: int = 76) -> tuple[str, str]:
    """(date, precision) as DuckDB expressions."""
    low = f"translate(lower({text}), '{ACCENTS[0]}', '{ACCENTS[1]}')"
    # the pattern engine has no look-ahead: the character after a day of the week is taken and put back
    t = f"trim(regexp_replace(regexp_replace({low}, '[ \\t\\n\\r]+', ' ', 'g'), '(^|[^a-z])(?:{_DAYS})(?:[.,]+|([^a-z])|$)', '\\1\\2', 'g'))"
    dates, kinds = [], []
    for pattern, (y, m, d) in FORMS:
        p = pattern.replace("'", "''")
        found = f"regexp_extract({t}, '{p}', {m})"
        number = lambda g, p=p: f"TRY_CAST(regexp_extract({t}, '{p}', {g}) AS INT)"
        year = f"({default_year})::INT" if not y else f"CASE WHEN {number(y)} >= 100 THEN {number(y)} WHEN {number(y)} >= {year_pivot} THEN {number(y)} + 1900 ELSE {number(y)} + 2000 END"
        month = f"CASE {found} " + " ".join(f"WHEN '{n}' THEN {k}" for k, names in MONTHS.items() for n in names) + " END"
        day = number(d) if d else "1"
        made = f"TRY_CAST(lpad(({year})::VARCHAR, 4, '0') || '-' || lpad(({month})::VARCHAR, 2, '0') || '-' || lpad(({day})::VARCHAR, 2, '0') AS DATE)"
        dates.append(f"WHEN {found} <> '' THEN {made}")
        kinds.append(f"WHEN {found} <> '' THEN '{'day' if y and d else 'day of year' if d else 'month'}'")
    date = f"CASE {' '.join(dates)} END"
    return date, f"CASE WHEN ({date}) IS NOT NULL THEN CASE {' '.join(kinds)} END END"
