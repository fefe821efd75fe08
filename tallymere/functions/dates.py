"""The two date parsers of the feeds, and helpers around them. Dates in and out are strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let
from .names import SPACES, trim

# Month names by their first three letters.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters, null for others."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(F.substring(name, 1, 3)))
    return F.nullif(at.cast("int"), F.lit(0))


def _rolled(year: Column, month: Column, day: Column) -> Column:
    """Year, month and day as a date; days and months beyond the last one roll over."""
    start = F.make_date(year, F.lit(1), F.lit(1))
    return F.date_add(F.add_months(start, month - 1), day - 1)


def parse_date(c: Column) -> Column:
    """Lenient parser: ISO dates, D-Mon-YYYY, D Mon YYYY, and ISO date-times by their date. Days past the end of a month roll over.

    Other texts give null.
    """
    iso = r"^(\d{4})-(\d{2})-(\d{2})(?:T.*)?$"
    worded = rf"^(\d{{1,4}})(?:-|[{SPACES}]+)([A-Za-z]{{3,}})(?:-|[{SPACES}]+)(\d{{4}})$"
    whole = lambda s, pattern, i: F.regexp_extract(s, pattern, i).try_cast("int")

    def parsed(s: Column) -> Column:
        from_iso = _rolled(whole(s, iso, 1), whole(s, iso, 2), whole(s, iso, 3))
        from_words = _rolled(whole(s, worded, 3), month_number(F.regexp_extract(s, worded, 2)), whole(s, worded, 1))
        return F.when(s.rlike(iso), from_iso).when(s.rlike(worded), from_words)

    return let(trim(c), parsed)


def iso_date(c: Column) -> Column:
    return F.date_format(parse_date(c), "yyyy-MM-dd")


def event_date(c: Column) -> Column:
    """Strict parser of event dates: ISO as it stands with month 1-12 and day 1-31, or D-Mon-YYYY; else null."""
    worded = r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$"

    def parsed(s: Column) -> Column:
        month, day = F.substring(s, 6, 2).try_cast("int"), F.substring(s, 9, 2).try_cast("int")
        number, d = month_number(F.regexp_extract(s, worded, 2)), F.regexp_extract(s, worded, 1).try_cast("int")
        spelt = F.format_string("%s-%02d-%02d", F.regexp_extract(s, worded, 3), number, d)
        return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.when(month.between(1, 12) & day.between(1, 31), s)).when(
            s.rlike(worded), F.when(number.isNotNull() & d.between(1, 31), spelt)
        )

    return let(trim(c), parsed)


def epoch_date(ms: Column) -> Column:
    """UTC day of epoch milliseconds; null for null and 0."""
    return F.when(ms != 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"))


def premium_date(c: Column) -> Column:
    """DD-MM-YYYY reordered, without validation."""
    pattern = r"^(\d{2})-(\d{2})-(\d{4})$"
    return F.when(c.rlike(pattern), F.regexp_replace(c, pattern, "$3-$2-$1"))


def within_days(a: Column, b: Column, days: int = 30) -> Column:
    """Both dates parse and are at most ``days`` apart; else false."""
    return F.coalesce(F.abs(F.datediff(parse_date(a), parse_date(b))) <= days, F.lit(False))


def date_range(c: Column) -> Column:
    """Struct of start and end of a text such as ``05th - 09th Jun 2026``: the first month and year count for both days."""

    def parts(s: Column) -> Column:
        month_year = F.regexp_extract(s, rf"([A-Za-z]{{3,9}}[{SPACES}]+\d{{4}})", 1)
        days = F.regexp_extract_all(s, F.lit(r"(?<![A-Za-z0-9_])(\d{1,2})(?![A-Za-z0-9_])"), 1)
        return F.struct(s.alias("s"), month_year.alias("month_year"), days.alias("days"))

    def of(p: Column) -> Column:
        some = (p["month_year"] != "") & (F.size(p["days"]) > 0)
        day = lambda i: iso_date(F.when(some, F.concat_ws(" ", F.try_element_at(p["days"], F.lit(i)), p["month_year"])).otherwise(p["s"]))
        return F.struct(day(1).alias("start"), day(-1).alias("end"))

    return let(let(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)(\d+)(st|nd|rd|th)", "$1"), parts), of)


def infer_status(start: Column, end: Column, listing: Column, today: str) -> Column:
    now = F.lit(today)
    return let(F.struct(start.alias("s"), end.alias("e"), listing.alias("l")), lambda d: (
        F.when(d["l"] < now, "listed").when(d["e"] < now, "closed").when(d["s"] > now, "upcoming").when((d["s"] <= now) & (now <= d["e"]), "open")
    ))
