"""Query functions over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import premium_percentage
from ..functions.names import nonzero
from ..schemas import KNOWN_SOURCES
from .entity import to_cards
from .match import best_premium
from .series import historical

SORTS = {"listingDate": "listing_date", "name": "company_name", "createdAt": "created_at", "biddingStart": "bidding_start", "date": "bidding_start", "latest": "bidding_start"}
LIVE = ("open", "upcoming")
# Why an entity is skipped; the first is followed by its status and the second.
STATUS, NOT_LIVE, NO_PREMIUM, NO_CANDLES = "status ", " — no live GMP", "no GMP found", "no candle data"


def page_of(page, limit) -> tuple[int, int]:
    """Page from 1 and limit from 1 to 200, of any input; a limit that is no number, or 0, is 50."""

    def whole(x) -> int:
        try:
            return int(str(x).strip())
        except ValueError:
            return 0

    return max(1, whole(page) or 1), min(200, max(1, whole(limit) or 50))


def matching(entities: DataFrame, status=None, source=None, document=None, search=None) -> DataFrame:
    """Filters of the listing; ``search`` is a case-insensitive regular expression over name, symbol and isin."""
    if status:
        entities = entities.where(F.col("status") == status)
    if source:
        entities = entities.where(F.map_contains_key("sources", source))
    if document:
        entities = entities.where(F.map_contains_key("documents", document))
    if search:
        hit = lambda c: F.coalesce(F.col(c).rlike(f"(?i){search}"), F.lit(False))
        entities = entities.where(hit("company_name") | hit("symbol") | hit("isin"))
    return entities


def order_of(sort: str | None = None, order: str | None = None) -> list:
    """Sort of the listing; descending unless asked for, with slug as the last tie-break."""
    column = SORTS.get(sort or "", "bidding_start")
    own = F.col(column).asc() if order == "asc" else F.col(column).desc()
    ties = [] if column == "company_name" else [F.col("updated_at").desc(), F.col("created_at").desc()]
    return [own, *ties, F.col("slug")]


def list_entities(entities: DataFrame, status=None, source=None, document=None, search=None, sort=None, order=None, page=None, limit=None) -> DataFrame:
    """A page of index cards."""
    page, limit = page_of(page, limit)
    found = matching(entities, status, source, document, search).orderBy(*order_of(sort, order))
    return to_cards(found.offset((page - 1) * limit).limit(limit))


def count_entities(entities: DataFrame, page=None, limit=None, **filters) -> DataFrame:
    """One row: total, has_more."""
    page, limit = page_of(page, limit)
    total = F.count(F.lit(1))
    return matching(entities, **filters).agg(total.alias("total"), (total > page * limit).alias("has_more"))


def get_entity(entities: DataFrame, slug: str, raw: bool = False) -> DataFrame:
    """One entity without its payloads, or its payloads alone."""
    one = entities.where(F.col("slug") == slug)
    return one.select("raw_sources") if raw else one.drop("raw_sources")


def source_health(entities: DataFrame) -> DataFrame:
    """Of each known source: entities, healthy, last_fetched."""
    seen = entities.select(F.explode("sources").alias("source", "meta")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("meta.last_fetched").alias("last_fetched"))
    known = entities.sparkSession.createDataFrame([(s,) for s in KNOWN_SOURCES], "source string")
    n = F.coalesce("n", F.lit(0))
    return known.join(seen, "source", "left").select("source", n.alias("ipos"), (n > 0).alias("healthy"), "last_fetched")


def premium_history(history: DataFrame, slug: str, most: int = 500) -> DataFrame:
    return history.where(F.col("slug") == slug).orderBy(F.col("date").desc()).limit(most)


def premium_run(entities: DataFrame, entries: DataFrame, now: str, slugs: list[str] | DataFrame | None = None, status: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Premiums matched to entities (slug, value, percentage, source, updated_at), and skipped ones (slug, reason). ``slugs``: a short list, or a table (slug) of any size."""
    if isinstance(slugs, DataFrame):
        targets = entities.join(slugs, "slug", "left_semi")
    elif slugs:
        targets = entities.where(F.col("slug").isin(slugs))
    elif status in (None, "all"):
        targets = entities.where(F.col("status").isin(*LIVE))
    else:
        targets = entities.where(F.col("status") == status)
    targets = targets.select("slug", "company_name", "status")
    live = F.coalesce(F.col("status").isin(*LIVE), F.lit(False))
    met = best_premium(targets.where(live).select("slug", "company_name"), entries).where("gmp <> 0")
    hits = met.select("slug", F.col("gmp").alias("value"), premium_percentage(F.col("gmp_percent"), F.col("gmp"), F.col("price")).alias("percentage"), F.lit("investorgain").alias("source"), F.lit(now).alias("updated_at"))
    wrong = targets.where(~live).select("slug", F.concat(F.lit(STATUS), F.coalesce("status", F.lit("null")), F.lit(NOT_LIVE)).alias("reason"))
    missed = targets.where(live).join(hits, "slug", "left_anti").select("slug", F.lit(NO_PREMIUM).alias("reason"))
    return hits, wrong.unionByName(missed)


def with_premium(entities: DataFrame, hits: DataFrame, now: str) -> DataFrame:
    """Entities with the matched premiums written in."""
    new = hits.select("slug", F.struct("value", "percentage", "source", "updated_at").alias("_gmp"))
    out = entities.join(new, "slug", "left")
    return out.withColumns({"gmp": F.coalesce("_gmp", "gmp"), "updated_at": F.when(F.col("_gmp").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))}).drop("_gmp")


def historical_run(entities: DataFrame, candles: DataFrame, status: str = "listed", since: str | None = None, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """Listing blocks of eligible entities by slug, and skipped slugs. ``since`` compares texts."""
    targets = entities.where((F.col("status") == status) & F.col("isin").isNotNull())
    if since:
        targets = targets.where(F.col("listing_date") >= since)
    targets = targets.orderBy("slug").limit(min(100, limit or 10))
    issue = F.coalesce(nonzero(F.col("issue_price")), nonzero(F.col("price_band.max")))
    own = targets.select("slug", "isin", F.substring("listing_date", 1, 10).alias("since"), issue.alias("issue"))
    rows = own.join(candles, "isin").where("since is null or date >= since")
    blocks = historical(rows, "slug", F.col("issue"))
    return blocks, targets.join(blocks, "slug", "left_anti").select("slug", F.lit(NO_CANDLES).alias("reason"))


def with_historical(entities: DataFrame, blocks: DataFrame, now: str) -> DataFrame:
    """Entities with the listing blocks (slug, then the block's columns) written in over former ones."""
    new = blocks.select("slug", F.struct(*[c for c in blocks.columns if c != "slug"]).alias("_block"))
    out = entities.join(new, "slug", "left")
    block = F.coalesce("_block", "historical") if "historical" in entities.columns else F.col("_block")
    return out.withColumns({"historical": block, "updated_at": F.when(F.col("_block").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))}).drop("_block")


def estimate(spark: SparkSession, path: str) -> DataFrame:
    """One row: status, ipos, as health(), of a stored table, from the footers of its Parquet files; no row is read.

    The reader that can do this is another than the usual one, so it is chosen in a session of its own.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return health(own.read.parquet(path))


def health(entities: DataFrame) -> DataFrame:
    """One row: status, ipos."""
    return entities.agg(F.count(F.lit(1)).alias("ipos")).select(F.lit("ok").alias("status"), "ipos")


def latest_of(frame: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return frame.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
