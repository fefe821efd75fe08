"""Deterministic feeds over the shared tables, in Spark and as SQL.

The tables hold no listings, so each document stands for one record of the feed
``doc_id % 4``: its first three words are the company, and the other fields are
arithmetic on doc_id and n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RANK
from ..sources.mappers import standard_records
from .catalog import TODAY, table

BASE = """
base AS (
  SELECT doc_id AS i, n_chars AS n,
    array_to_string(string_split(text, ' ')[1:3], ' ') || CASE (doc_id // 4) % 4 WHEN 0 THEN ' Limited' WHEN 1 THEN ' Ltd.' WHEN 2 THEN ' IPO' ELSE '' END AS name,
    CASE WHEN doc_id % 3 = 0 THEN 'INE' || lpad((doc_id % 199)::VARCHAR, 9, '0') END AS isin,
    CASE WHEN doc_id % 5 = 0 THEN 'SYM' || (doc_id % 121)::VARCHAR || CASE doc_id % 3 WHEN 0 THEN '-EQ' WHEN 1 THEN '.NS' ELSE '' END END AS symbol,
    DATE '2024-01-01' + ((doc_id * 7) % 120)::INTEGER AS d,
    (n_chars % 500 + 20)::INTEGER AS low, (n_chars % 500 + 20 + n_chars % 17)::INTEGER AS high
  FROM documents)"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n_chars")
    pick = lambda of, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (of + 1).cast("int"))
    low = (n % 500 + 20).cast("int")
    return table(spark, sf_dir, "documents").select(
        i.alias("i"), n.alias("n"),
        F.concat(F.substring_index("text", " ", 3), pick(F.shiftright(i, 2) % 4, " Limited", " Ltd.", " IPO", "")).alias("name"),
        F.when(i % 3 == 0, F.concat(F.lit("INE"), F.lpad((i % 199).cast("string"), 9, "0"))).alias("isin"),
        F.when(i % 5 == 0, F.concat(F.lit("SYM"), (i % 121).cast("string"), pick(i % 3, "-EQ", ".NS", ""))).alias("symbol"),
        F.date_add(F.lit("2024-01-01").cast("date"), ((i * 7) % 120).cast("int")).alias("d"), low.alias("low"), (low + n % 17).cast("int").alias("high"),
    )


def _iso(days: int = 0):
    return F.date_format(F.date_add("d", days), "yyyy-MM-dd")


def _worded(days: int = 0):
    return F.date_format(F.date_add("d", days), "dd-MMM-yyyy")


def _text(c: str):
    return F.col(c).cast("string")


def feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Landing rows (ord, payload) of each feed."""
    rows = base(spark, sf_dir)
    lit, col = F.lit, F.col
    url = lambda kind: F.concat(lit("https://docs.example.com/"), _text("i"), lit(f"-{kind}.pdf/"))
    of = lambda k: rows.where(col("i") % 4 == k)
    state = lambda *values: F.element_at(F.array(*[lit(v) for v in values]), (F.shiftright("i", 2) % 4 + 1).cast("int"))
    out = {
        "upstox": of(0).select(col("i").alias("ord"), F.to_json(F.struct(
            _text("i").alias("id"), "symbol", "name", state("upcoming", "open", "closed", "listed").alias("status"), "isin",
            F.when(col("i") % 8 == 0, "SME IPO").otherwise("MAIN").alias("issue_type"), F.concat(lit("IND"), (col("i") % 7).cast("string")).alias("industry"),
            col("n").cast("double").alias("issue_size"), col("low").cast("double").alias("minimum_price"), col("high").cast("double").alias("maximum_price"),
            (10 + col("i") % 90).cast("double").alias("lot_size"), lit(10.0).alias("face_value"), _iso().alias("bidding_start_date"), _iso(3).alias("bidding_end_date"),
            F.when(col("i") % 8 == 0, url("rhp")).alias("rhp_url"), F.struct(_worded(6).alias("allotment_date"), _iso(10).alias("listing_date")).alias("timeline"),
        )).alias("payload")),
        "nse": of(1).select(col("i").alias("ord"), F.to_json(F.struct(
            "symbol", col("name").alias("companyName"), state("Active", "Past", "upcoming", "Forthcoming").alias("status"), _worded().alias("issueStartDate"), _worded(3).alias("issueEndDate"),
            F.when(col("i") % 8 == 1, F.upper(_worded(9))).alias("listingDate"), F.concat(lit("Rs."), _text("low"), lit(" to Rs."), _text("high")).alias("priceRange"),
            F.struct("isin", F.when(col("i") % 3 == 1, url("drhp")).alias("drhpUrl")).alias("metaInfo"),
        )).alias("payload")),
        "groww": of(2).select(col("i").alias("ord"), F.to_json(F.struct(
            F.struct("symbol", "isin", col("name").alias("companyName"), F.concat(lit("g"), _text("i")).alias("searchId"), (F.unix_date("d").cast("long") * 86_400_000).alias("bidStartTimestamp"),
                     F.array(F.struct(col("low").cast("double").alias("minPrice"), col("high").cast("double").alias("maxPrice"))).alias("categories")).alias("list"),
            F.when(col("i") % 8 == 6, F.struct(
                state("ACTIVE", "CLOSED", "UPCOMING", "LISTED").alias("status"), _iso(1).alias("startDate"), _iso(4).alias("endDate"), url("file").alias("documentUrl"),
                F.concat(lit("SEC"), (col("i") % 5).cast("string")).alias("sector"), (col("i") % 16 == 6).alias("isSme"), (col("low") + 1).cast("double").alias("minPrice"), (col("high") + 1).cast("double").alias("maxPrice"),
                (20 + col("i") % 9).cast("double").alias("lotSize"), F.array(
                    F.struct(lit("QIB").alias("category"), (col("n") / 7).alias("subscriptionRate")), F.struct(lit("Retail").alias("category"), (col("n") / 11).alias("subscriptionRate")),
                    F.struct(lit("QIB").alias("category"), (col("n") / 13).alias("subscriptionRate"))).alias("subscriptionRates"),
            )).alias("detail"), state("open", "upcoming", "closed", "closed").alias("bucket"),
        )).alias("payload")),
        "zerodha": of(3).select(col("i").alias("ord"), F.to_json(F.struct(
            "symbol", F.when(col("i") % 8 == 3, "SME").otherwise("").alias("type"), (col("i") % 8 == 3).alias("isSme"), col("name").alias("companyName"), F.concat(lit("https://lists.example.com/ipo/"), _text("i"), lit("/")).alias("detailUrl"),
            F.concat(F.date_format("d", "dd"), lit("th – "), F.date_format("d", "dd"), lit("th "), F.date_format("d", "MMM yyyy")).alias("biddingRange"),
            _worded(12).alias("listingDateText"), F.concat(lit("₹"), _text("low"), lit(" – ₹"), _text("high")).alias("priceText"),
            F.when(col("i") % 8 == 7, url("draft")).alias("prospectusUrl"),
        )).alias("payload")),
    }
    return out


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard records of all four feeds."""
    return standard_records(feeds(spark, sf_dir), TODAY)


# The standard records as SQL, from the feeds' definition.
URL = "'https://docs.example.com/' || i || '-{}.pdf/'"
STATE = "(CASE (i // 4) % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{}' WHEN 2 THEN '{}' ELSE '{}' END)"
ISO = "strftime(d + {}, '%Y-%m-%d')"
RECORDS = f"""
{BASE},
std AS (
  SELECT 'upstox' AS src, i AS ord, isin, symbol, regexp_replace(name, '\\s+IPO$', '') AS company_name, {STATE.format("upcoming", "open", "closed", "listed")} AS status,
    {ISO.format(0)} AS bidding_start_date, low::DOUBLE AS low, high::DOUBLE AS high, CASE WHEN i % 8 = 0 THEN {URL.format("rhp")} END AS rhp, NULL::VARCHAR AS drhp, NULL::VARCHAR AS listing_date, i, n, d
  FROM base WHERE i % 4 = 0
  UNION ALL SELECT 'nse', {RANK} + i, isin, symbol, name, {STATE.format("open", "closed", "upcoming", "forthcoming")}, {ISO.format(0)}, low, high, NULL, CASE WHEN i % 3 = 1 THEN {URL.format("drhp")} END, NULL, i, n, d
  FROM base WHERE i % 4 = 1
  UNION ALL SELECT 'groww', {2 * RANK} + i, isin, symbol, name,
    CASE WHEN i % 8 = 6 THEN {STATE.format("open", "closed", "upcoming", "listed")} ELSE {STATE.format("open", "upcoming", "closed", "closed")} END,
    CASE WHEN i % 8 = 6 THEN {ISO.format(1)} ELSE {ISO.format(0)} END, low + (i % 8 = 6)::INT, high + (i % 8 = 6)::INT,
    CASE WHEN i % 8 = 6 AND (i // 4) % 4 <> 2 THEN {URL.format("file")} END, CASE WHEN i % 8 = 6 AND (i // 4) % 4 = 2 THEN {URL.format("file")} END, NULL, i, n, d
  FROM base WHERE i % 4 = 2
  UNION ALL SELECT 'zerodha', {3 * RANK} + i, NULL, symbol, name,
    CASE WHEN d + 12 < DATE '{TODAY}' THEN 'listed' WHEN d < DATE '{TODAY}' THEN 'closed' WHEN d > DATE '{TODAY}' THEN 'upcoming' ELSE 'open' END,
    {ISO.format(0)}, low, high, NULL, CASE WHEN i % 8 = 7 THEN {URL.format("draft")} END, {ISO.format(12)}, i, n, d
  FROM base WHERE i % 4 = 3)"""
