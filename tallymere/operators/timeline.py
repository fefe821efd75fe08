"""Event timelines and append-only status histories, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let
from ..functions.dates import event_date
from ..functions.names import filled
from ..schemas import EVENT, NSE, PARSE, TIMELINE_EVENTS, UPSTOX


def payload(source: str, schema: str) -> Column:
    return F.from_json(F.col("raw_sources")[source], schema, PARSE)


def _parsed(records: DataFrame) -> DataFrame:
    return records.withColumns({"_u": payload("upstox", UPSTOX), "_n": payload("nse", NSE)})


def _first_date(*columns: Column) -> Column:
    """The first that parses; those that don't fall through."""
    return F.coalesce(*[event_date(c) for c in columns])


def timeline() -> Column:
    """Struct of the six events, for records with parsed payloads _u and _n."""
    c = F.col
    opened = _first_date(c("_u.timeline.application_start_date"), c("_u.bidding_start_date"), c("_n.issueStartDate"), c("_n.ipoStartDate"), c("bidding_start_date"))
    closed = _first_date(c("_u.timeline.application_end_date"), c("_u.bidding_end_date"), c("_n.issueEndDate"), c("_n.ipoEndDate"))
    some = lambda *urls: F.coalesce(*[filled(u) for u in urls]).isNotNull()
    has_drhp = some(c("document_urls.drhp"), c("_u.drhp_url"), c("_n.metaInfo.drhpUrl"), c("_n.drhpUrl"))
    has_rhp = some(c("document_urls.rhp"), c("_u.rhp_url"), c("_n.metaInfo.rhpUrl"), c("_n.rhpUrl"))
    dates = F.struct(
        event_date(c("bidding_start_date")).alias("started"), opened.alias("open"), closed.alias("close"),
        _first_date(c("_u.timeline.allotment_date"), c("_u.timeline.allotment_start_date")).alias("allotment"),
        _first_date(c("_u.timeline.listing_date"), c("_n.listingDate"), c("listing_date")).alias("listing"),
    )
    return let(dates, lambda d: F.struct(
        F.when(has_drhp, F.coalesce(d["started"], d["open"])).alias("drhp_available"), F.when(has_rhp, F.coalesce(d["started"], d["open"])).alias("rhp_available"),
        d["open"].alias("open"), d["close"].alias("close"), d["allotment"].alias("allotment"), d["listing"].alias("listing"),
    ))


def event_source(event: str) -> Column:
    """Label of an event by which fields are present, whether or not they parse."""
    has = lambda *names: F.coalesce(*[filled(F.col(n)) for n in names]).isNotNull()
    own = {
        "open": (has("_u.timeline.application_start_date", "_u.bidding_start_date"), has("_n.issueStartDate", "_n.ipoStartDate")),
        "close": (has("_u.timeline.application_end_date", "_u.bidding_end_date"), has("_n.issueEndDate", "_n.ipoEndDate")),
        "allotment": (has("_u.timeline.allotment_date"), F.lit(False)),
        "listing": (has("_u.timeline.listing_date"), has("_n.listingDate")),
    }
    if event not in own:
        return F.lit("inferred")
    return F.when(own[event][0], "upstox").when(own[event][1], "nse").otherwise("inferred")


def append_history(history: Column, events: Column, now: str) -> Column:
    """History with the events of the timeline that it doesn't hold yet (by status and date); nothing is changed or removed."""
    fresh = F.array(*[
        F.struct(F.lit(e).alias("status"), events[e].alias("date"), event_source(e).alias("source"), F.lit(now).alias("detected_at")) for e in TIMELINE_EVENTS
    ])
    known = lambda before, e: F.exists(before, lambda h: (h["status"] == e["status"]) & (h["date"] == e["date"]))
    grown = lambda before: F.concat(before, F.filter(fresh, lambda e: e["date"].isNotNull() & ~known(before, e)))
    return let(F.coalesce(history, F.array().cast(f"array<{EVENT}>")), grown)


def with_timeline(records: DataFrame, now: str) -> DataFrame:
    """Adds timeline and status_history; an existing history is extended."""
    history = F.col("status_history") if "status_history" in records.columns else F.lit(None)
    timed = _parsed(records).withColumn("timeline", timeline())
    return timed.withColumn("status_history", append_history(history, F.col("timeline"), now)).drop("_u", "_n")


def with_event_sources(records: DataFrame) -> DataFrame:
    """Adds a map from event to source label."""
    pairs = [x for e in TIMELINE_EVENTS for x in (F.lit(e), event_source(e))]
    return _parsed(records).withColumn("event_sources", F.create_map(*pairs)).drop("_u", "_n")
