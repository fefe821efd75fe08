"""Whole scans of the four feeds: from landed lists and details to standard records.

``ord`` is the order of arrival over all lists of a feed.  Lists have columns
ord, bucket (which list an item came from) and payload; details have id (unique)
and payload, or html where the feed delivers pages.  What a feed's scan does
with both is said at each function; all are joins and windows over keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, names
from . import html, mappers
from .scans import first_of_key, last_of_key, limited_details, numbered, with_detail, without_listed

NSE_DEFAULTS = {"upcoming": "upcoming", "past": "closed"}
LIVE = ("upcoming", "open", "closed")


def _field(name: str, payload: str = "payload") -> Column:
    return names.filled(F.get_json_object(payload, f"$.{name}"))


def unpack(responses: DataFrame, members: tuple[str, ...] = ("ipoList", "data", "results")) -> DataFrame:
    """List items (ord, bucket, payload) of answered pages (ord, bucket, payload): the elements of the first of the members that is there.

    Items are numbered from 0 in the order of pages and places, whatever the orders of the pages are and however long they are.  An answer without a
    list gives no items.
    """
    found = F.coalesce(*[F.get_json_object("payload", f"$.{m}") for m in members])
    items = F.posexplode(F.from_json(F.when(found.startswith("["), found), "array<string>")).alias("place", "item")
    return numbered(responses.select(F.col("ord").alias("_page"), "bucket", items), "_page", "place").select("ord", "bucket", F.col("item").alias("payload"))


def with_member(payload: Column, name: str, value: Column) -> Column:
    """A JSON object with one more member, whose value is JSON; a member of that name before it is overruled. A null value adds nothing."""
    body = F.rtrim(payload)
    empty = payload.rlike(r"^\s*\{\s*\}\s*$")
    member = F.concat(F.lit(f'"{name}":'), value, F.lit("}"))
    more = F.when(empty, F.concat(F.lit("{"), member)).otherwise(F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(","), member))
    return F.when(value.isNull(), payload).otherwise(more)


def upstox(lists: DataFrame, details: DataFrame) -> DataFrame:
    """Items of the live lists, each by its detail where there is one; items that come twice stay twice."""
    live = lists.where(F.col("bucket").isin(*LIVE)).withColumn("id", _field("id"))
    return mappers.upstox(with_detail(live, details))


def nse(lists: DataFrame, details: DataFrame) -> DataFrame:
    """Current, upcoming and past items by symbol, else (past only) by name; the last one of a key wins, at the place of the first.

    Current and upcoming items without a symbol are dropped.  A list gives the
    status of items without one.  Past items with a symbol but without an isin
    take isin and listing date from their detail, which joins the payload.
    """
    past = F.col("bucket") == "past"
    items = lists.where(F.col("bucket").isin("current", "upcoming", "past")).withColumns({"id": _field("symbol"), "_isin": F.coalesce(_field("isin"), _field("metaInfo.isin"))})
    name = F.coalesce(_field("companyName"), _field("company"), F.lit("null"))
    items = items.withColumn("key", F.when(F.col("id").isNotNull(), F.concat(F.lit("SYM:"), "id")).when(past, F.concat(F.lit("NAME:"), name)))
    items = last_of_key(items, "key", "ord")
    asked = F.when(past & F.col("_isin").isNull(), F.col("id"))
    own = details.where(F.get_json_object("payload", "$.metaInfo").isNotNull()).select(F.col("id").alias("_id"), F.col("payload").alias("_detail"))
    met = items.join(own, asked == F.col("_id"), "left")
    rows = mappers.nse(met.select(F.col("position.ord").alias("ord"), with_member(F.col("payload"), "details", F.col("_detail")).alias("payload")))
    more = met.select(
        (F.col("position.ord") + mappers.first_ord("nse")).alias("ord"), "bucket",
        _field("metaInfo.isin", "_detail").alias("_isin"), _field("metaInfo.listingDate", "_detail").alias("_listed"),
    )
    usual = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(s)) for b, s in NSE_DEFAULTS.items()])
    met = rows.join(more, "ord").withColumns({"isin": F.coalesce("isin", "_isin"), "status": F.coalesce("status", usual), "listing_date": F.coalesce("_listed", "listing_date")})
    return met.select(*mappers.OUT)


def groww(lists: DataFrame, details: DataFrame | None, buckets: tuple[str, ...] = ("open", "upcoming", "closed"), docs_only: bool = False, include_listed: bool = False, max_details: int | None = None) -> DataFrame:
    """Items by search id, isin or symbol, the first one of a key; with their details, of the first ``max_details`` if that is set.

    Listed records go unless ``include_listed``; ``docs_only`` keeps search id
    and document url of the payload and nothing else.
    """
    items = lists.where(F.col("bucket").isin(*buckets)).withColumns({"id": _field("searchId"), "key": F.coalesce(_field("searchId"), _field("isin"), _field("symbol"))})
    items = first_of_key(items, "key", "ord")
    if details is None:
        met = items.withColumn("detail", F.lit(None).cast("string"))
    elif max_details is None:
        met = items.join(details.select("id", F.col("payload").alias("detail")), "id", "left")
    else:
        met = limited_details(items, details, max_details)
    both = F.concat(F.lit('{"list":'), "payload", F.lit(',"detail":'), F.coalesce("detail", F.lit("null")), F.lit(',"bucket":"'), "bucket", F.lit('"}'))
    rows = mappers.groww(met.select("ord", both.alias("payload")))
    if not include_listed:
        rows = without_listed(rows)
    if docs_only:
        raw = F.col("raw_sources.groww")
        kept = F.to_json(F.struct(F.get_json_object(raw, "$.searchId").alias("searchId"), F.get_json_object(raw, "$.documentUrl").alias("documentUrl")), {"ignoreNullFields": "false"})
        rows = rows.withColumn("raw_sources", F.create_map(F.lit("groww"), kept))
    return rows


def zerodha(pages: DataFrame, details: DataFrame | None, today: str, include_listed: bool = False, max_details: int | None = None, site: str = "https://lists.example.com") -> DataFrame:
    """Rows of list pages (ord, html), the first one of a detail page, with the prospectus link of that page (id: its path, html).

    Rows that their dates show as listed go before details are looked up, unless ``include_listed``.
    Rows that are left are numbered from 0 in the order of pages and places.
    """
    rows = html.extract_rows(pages).withColumnRenamed("detail_path", "id")
    rows = first_of_key(rows, "id", "ord", "place")
    span, listing = dates.date_range(F.col("bidding_range")), dates.iso_date(F.col("listing_date_text"))
    if not include_listed:
        rows = rows.where(~dates.infer_status(span["start"], span["end"], listing, today).eqNullSafe("listed"))
    rows = numbered(rows.withColumnRenamed("ord", "_page"), "_page", "place")
    if details is not None:
        if max_details is not None:
            details = details.join(rows.orderBy("ord").limit(max_details).select("id"), "id", "left_semi")
        rows = rows.join(html.extract_prospectus(details.select("id", "html")), "id", "left")
    else:
        rows = rows.withColumn("prospectus_url", F.lit(None).cast("string"))
    payload = F.to_json(F.struct(
        "symbol", "type", F.col("is_sme").alias("isSme"), F.col("company_name").alias("companyName"), F.concat(F.lit(site), "id").alias("detailUrl"), F.col("bidding_range").alias("biddingRange"),
        F.col("listing_date_text").alias("listingDateText"), F.col("price_text").alias("priceText"), F.col("prospectus_url").alias("prospectusUrl"),
    ))
    return mappers.zerodha(rows.select("ord", payload.alias("payload")), today)
