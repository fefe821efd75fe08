"""Projection of merged records to listing entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let
from ..functions.names import bare_url, filled, first_filled, nonzero, slug
from ..functions.numbers import half_up
from ..schemas import GROWW, NSE, UPSTOX, ZERODHA
from .timeline import payload

DOCUMENT = "struct<url:string,source:string,status:string,markdown_url:string,page_hashes:array<string>>"


def _parsed(records: DataFrame) -> DataFrame:
    return records.withColumns({"_u": payload("upstox", UPSTOX), "_n": payload("nse", NSE), "_g": payload("groww", GROWW), "_z": payload("zerodha", ZERODHA)})


def issue_type() -> Column:
    """SME or MAINBOARD from whichever source knows first."""
    sme = lambda c: F.when(c.rlike("(?i)sme"), "SME").otherwise("MAINBOARD")
    flag = lambda c: F.when(c, "SME").otherwise("MAINBOARD")
    up, kind = filled(F.col("_u.issue_type")), filled(F.col("_g.detail.issueType"))
    return (
        F.when(up.isNotNull(), sme(up)).when(F.col("_g.detail.isSme").isNotNull(), flag(F.col("_g.detail.isSme")))
        .when(F.col("_z.isSme").isNotNull(), flag(F.col("_z.isSme"))).when(kind.isNotNull(), sme(kind))
    )


def documents_map() -> Column:
    """Map of document type to url and source; the first writer of a type wins."""
    c = F.col
    meta = lambda key: F.coalesce(filled(c(f"_n.metaInfo.{key}")), F.when(c("_n.metaInfo").isNull(), filled(c(f"_n.details.metaInfo.{key}"))))
    offers = [
        (F.lit("rhp"), c("document_urls.rhp"), "merged"), (F.lit("drhp"), c("document_urls.drhp"), "merged"),
        (F.lit("rhp"), c("_u.rhp_url"), "upstox"), (F.lit("drhp"), c("_u.drhp_url"), "upstox"),
        (F.lit("rhp"), c("_n.rhpUrl"), "nse"), (F.lit("drhp"), c("_n.drhpUrl"), "nse"),
        (F.lit("rhp"), meta("rhpUrl"), "nse"), (F.lit("drhp"), meta("drhpUrl"), "nse"),
        (F.coalesce(filled(c("_g.docType")), F.lit("drhp")), first_filled(c("_g.documentUrl"), c("_g.detail.documentUrl")), "groww"),
        (F.coalesce(filled(c("_z.docType")), F.lit("drhp")), c("_z.prospectusUrl"), "zerodha"),
    ]
    entries = F.array(*[F.struct(kind.alias("kind"), filled(url).alias("url"), F.lit(source).alias("source")) for kind, url, source in offers])

    def mapped(some: Column) -> Column:
        value = lambda e: F.struct(
            bare_url(e["url"]).alias("url"), e["source"].alias("source"), F.lit(None).cast("string").alias("status"),
            F.lit(None).cast("string").alias("markdown_url"), F.lit(None).cast("array<string>").alias("page_hashes"),
        )
        first = lambda kind: let(F.get(F.filter(some, lambda e: e["kind"] == kind), 0), value)
        kinds = F.array_distinct(F.transform(some, lambda e: e["kind"]))
        return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, first(k))))

    return let(F.filter(entries, lambda e: e["url"].isNotNull()), mapped)


def subscription(rates: Column) -> Column:
    """Pivot of rates by category; of a repeated category the last counts, and nothing known gives null."""
    names = {"retail": "RETAIL", "qualified": "QIB", "nii": "NII", "total": "TOTAL"}

    def of(all_rates: Column, category: str) -> Column:
        own = F.filter(all_rates, lambda r: F.upper(F.coalesce(r["category"], F.lit(""))) == category)
        return half_up(F.try_element_at(own, F.lit(-1))["subscriptionRate"])

    pivot = let(rates, lambda all_rates: F.struct(*[of(all_rates, category).alias(name) for name, category in names.items()]))
    return let(pivot, lambda s: F.when(F.coalesce(*[s[name] for name in names]).isNotNull(), s))


def sources_meta(now: str) -> Column:
    """Of each source of a record, when it was fetched and from where."""
    url = lambda v: first_filled(F.get_json_object(v, "$.detailUrl"), F.get_json_object(v, "$.url"))
    return F.transform_values("raw_sources", lambda k, v: F.struct(F.lit(now).alias("last_fetched"), url(v).alias("url")))


def to_entities(records: DataFrame, now: str, *keep: str) -> DataFrame:
    """Merged records (with timeline and status_history) to entities, by each field's precedence of sources; columns ``keep`` stay."""
    c = F.col
    d = "_g.detail"
    lot = F.coalesce(c("_u.lot_size"), c(f"{d}.lotSize"))
    top = c("price_band.maximum")
    application_end = c("_u.timeline.application_end_date")
    return _parsed(records).select(
        slug(first_filled(c("company_name"), c("symbol"))).alias("slug"),
        filled(c("isin")).alias("isin"), filled(c("symbol")).alias("symbol"), filled(c("company_name")).alias("company_name"),
        F.concat(filled(c("company_name")), F.lit(" IPO")).alias("display_name"), filled(c("status")).alias("status"),
        issue_type().alias("issue_type"),
        first_filled(c(f"{d}.sector"), c("_u.industry")).alias("sector"), first_filled(c("_u.industry"), c(f"{d}.sector")).alias("industry"),
        F.coalesce(c("_u.face_value"), c(f"{d}.faceValue")).alias("face_value"),
        F.struct(c("price_band.minimum").alias("min"), top.alias("max")).alias("price_band"),
        F.coalesce(c(f"{d}.issuePrice"), c("_u.cut_off_price")).alias("issue_price"),
        lot.alias("lot_size"), (nonzero(lot) * nonzero(top)).alias("minimum_amount"),
        F.coalesce(c(f"{d}.issueSize"), c("_u.issue_size")).alias("issue_size"),
        first_filled(c("bidding_start_date"), c(f"{d}.startDate"), c("_u.bidding_start_date")).alias("bidding_start"),
        first_filled(c(f"{d}.endDate"), c("_u.bidding_end_date"), application_end).alias("bidding_end"),
        first_filled(c("listing_date"), c(f"{d}.listingDate"), c("_u.timeline.listing_date")).alias("listing_date"),
        first_filled(c(f"{d}.lastBidPlaceTime"), application_end).alias("cutoff_time"),
        first_filled(c(f"{d}.allotmentDate"), c("_u.timeline.allotment_date")).alias("allotment_date"),
        first_filled(c(f"{d}.registrar")).alias("registrar"),
        F.lit(None).cast("struct<value:double,percentage:double,source:string,updated_at:string>").alias("gmp"),
        subscription(c(f"{d}.subscriptionRates")).alias("subscription"), documents_map().alias("documents"),
        sources_meta(now).alias("sources"), "raw_sources", "status_history", "timeline", F.lit(now).alias("updated_at"), *keep,
    )


def to_cards(entities: DataFrame) -> DataFrame:
    """The index view of entities."""
    same = (
        "slug", "company_name", "display_name", "isin", "symbol", "status", "issue_type", "price_band", "lot_size", "issue_size", "bidding_start",
        "bidding_end", "listing_date", "sector", "documents", "updated_at", "created_at",
    )
    return entities.select(*same, F.col("gmp.value").alias("gmp"), F.map_keys("sources").alias("sources"))
