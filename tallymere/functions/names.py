"""Normal forms of company names and symbols, slugs and links.

Word boundaries and white space are spelt out: the feeds' rules treat only
ASCII letters, digits and underscore as word characters, and all Unicode spaces
as white space, which differs from the regex defaults here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
# What counts as white space, and the words without meaning for a name.
SPACES = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{2000}-\x{200A}"
COMPANY_WORDS = r"limited|ltd\.?|corporation|corp\.?|company|co\.?|ipo|details"
PREMIUM_WORDS = r"limited|ltd\.?|ipo"
SLUG_WORDS = r"limited|ltd\.?|private|pvt\.?|ipo"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACES}]+|[{SPACES}]+$", "")


def _key(c: Column, words: str) -> Column:
    bare = F.regexp_replace(F.lower(c), f"{BOUNDARY}(?:{words}){BOUNDARY}", "")
    bare = F.regexp_replace(bare, f"[^a-z0-9{SPACES}]", "")
    return F.coalesce(trim(F.regexp_replace(bare, f"[{SPACES}]+", " ")), F.lit(""))


def company_key(c: Column) -> Column:
    """Name for matching entities; '' for null."""
    return _key(c, COMPANY_WORDS)


def premium_key(c: Column) -> Column:
    """Name for matching premium feeds, which strip fewer words."""
    return _key(c, PREMIUM_WORDS)


def symbol_key(c: Column) -> Column:
    """Upper case without series and exchange suffixes. Trimmed last, so a trailing space keeps the suffix."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(c), r"-(BE|EQ)$", ""), r"\.(NS|BO)$", "")
    return F.coalesce(trim(bare), F.lit(""))


def slug(name: Column, suffix: Column | None = None) -> Column:
    base = F.lower(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")))
    base = F.regexp_replace(F.replace(base, F.lit("&"), F.lit(" and ")), f"{BOUNDARY}(?:{SLUG_WORDS}){BOUNDARY}", " ")
    base = F.regexp_replace(F.trim(F.regexp_replace(base, "[^a-z0-9]+", " ")), " +", "-")
    out = F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit("unknown")), F.lit("-ipo"))
    if suffix is None:
        return out
    tail = F.concat(F.lit("-"), F.regexp_replace(F.lower(suffix), "[^a-z0-9]+", ""))
    return F.concat(out, F.when(F.coalesce(suffix, F.lit("")) == "", "").otherwise(tail))


def bare_url(c: Column) -> Column:
    """Trimmed, without trailing slashes; '' for null."""
    return F.regexp_replace(trim(F.coalesce(c, F.lit(""))), "/+$", "")


def instrument_key(exchange: Column, isin: Column) -> Column:
    return F.concat_ws("|", exchange, isin)


def document_class(url: Column) -> Column:
    """drhp, rhp or final, by words in a document's url; drhp if it says nothing."""
    low = F.lower(url)
    has = lambda *words: F.greatest(*[low.contains(w) for w in words]) if len(words) > 1 else low.contains(words[0])
    return (
        F.when(F.coalesce(url, F.lit("")) == "", None).when(has("drhp", "draft"), "drhp").when(has("rhp", "red-herring"), "rhp")
        .when(has("final"), "final").otherwise("drhp")
    )


def filled(c: Column) -> Column:
    """Null for the empty string, as the feeds treat it as missing."""
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[filled(c) for c in columns])


def first_delivered(*columns: Column) -> Column:
    """As first_filled, but the empty string where none is filled and one was delivered empty; null only where there is none."""
    return F.coalesce(*[filled(c) for c in columns], *columns)


def nonzero(c: Column) -> Column:
    """Null for 0 and NaN, where a feed's 0 means missing."""
    return F.nullif(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
