"""Queries over whole scans of the four feeds.

The landed lists are made of all documents: number, name, keys and dates as in
``feeds.base``; every listing's place in the lists and its detail are arithmetic
on its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RANK
from ..sources import feeds as scans
from .catalog import TODAY, query, table
from .feeds import BASE, base

SHOWN = ["ord", "isin", "symbol", "company_name", "status", "bidding_start_date", "listing_date"]


def _text(c: str):
    return F.col(c).cast("string")


def _pick(at, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def _shown(records: DataFrame, *more) -> DataFrame:
    return records.select(*SHOWN, F.col("price_band.minimum").alias("low"), F.col("document_urls.rhp").alias("rhp"), F.col("document_urls.drhp").alias("drhp"), *more)


@query(f"""WITH {BASE} SELECT i AS ord, CASE WHEN i % 3 = 1 THEN 'INU' || i ELSE isin END AS isin, symbol, CASE WHEN i % 3 = 1 THEN 'Detail ' || i ELSE regexp_replace(name, '\\s+IPO$', '') END AS company_name,
['upcoming', 'open', 'closed'][1 + i % 4] AS status, CASE WHEN i % 3 <> 1 THEN strftime(d, '%Y-%m-%d') END AS bidding_start_date, NULL::VARCHAR AS listing_date, CASE WHEN i % 3 <> 1 THEN low::DOUBLE END AS low,
CASE WHEN i % 3 = 1 THEN 'https://docs.example.com/' || i END AS rhp, NULL::VARCHAR AS drhp FROM base WHERE i % 4 <> 3""")
def q_scan_upstox(spark, sf_dir):
    """All documents are list items, a quarter of them in the listed bucket, which is not read; a third have a detail."""
    rows, i = base(spark, sf_dir), F.col("i")
    item = F.to_json(F.struct(_text("i").alias("id"), "symbol", "name", "isin", _pick(i % 4, "upcoming", "open", "closed", "listed").alias("status"), F.date_format("d", "yyyy-MM-dd").alias("bidding_start_date"), F.col("low").cast("double").alias("minimum_price")))
    lists = rows.select(i.alias("ord"), _pick(i % 4, "upcoming", "open", "closed", "listed").alias("bucket"), item.alias("payload"))
    detail = F.to_json(F.struct(_text("i").alias("id"), "symbol", F.concat(F.lit("Detail "), _text("i"), F.lit(" IPO")).alias("name"), F.concat(F.lit("INU"), _text("i")).alias("isin"),
                                _pick(i % 4, "upcoming", "open", "closed", "listed").alias("status"), F.concat(F.lit("https://docs.example.com/"), _text("i")).alias("rhp_url")))
    details = rows.where("i % 3 = 1").select(_text("i").alias("id"), detail.alias("payload"))
    return _shown(scans.upstox(lists, details))


@query(f"""WITH {BASE}, l AS (SELECT (i % 3) * 1000000000 + i AS ord, i % 3 AS no, i, symbol AS y, name AS c, CASE WHEN i % 2 = 0 THEN isin END AS isin, d, low,
  CASE (i // 3) % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' WHEN 2 THEN 'forthcoming' END AS own FROM base),
d AS (SELECT symbol AS dy, 'IND' || min(i) AS di, strftime(min(d), '%d-%b-%Y') AS dl FROM base WHERE symbol IS NOT NULL AND i % 4 < 3 GROUP BY symbol),
k AS (SELECT *, CASE WHEN y IS NOT NULL THEN 'SYM:' || y WHEN no = 2 THEN 'NAME:' || c END AS key FROM l),
r AS (SELECT *, min(ord) OVER (PARTITION BY key) AS place, row_number() OVER (PARTITION BY key ORDER BY ord DESC) AS n FROM k WHERE key IS NOT NULL),
m AS (SELECT r.*, di, dl FROM r LEFT JOIN d ON no = 2 AND isin IS NULL AND y = dy WHERE n = 1)
SELECT {RANK} + place AS ord, coalesce(isin, di) AS isin, y AS symbol, c AS company_name, coalesce(own, CASE no WHEN 1 THEN 'upcoming' WHEN 2 THEN 'closed' END) AS status,
strftime(d, '%Y-%m-%d') AS bidding_start_date, dl AS listing_date, low::DOUBLE AS low, NULL::VARCHAR AS rhp, NULL::VARCHAR AS drhp, CASE WHEN di IS NULL THEN NULL ELSE di END AS detail_isin FROM m""")
def q_scan_nse(spark, sf_dir):
    """All documents in three lists; symbols repeat across them, so later lists replace items; details by symbol."""
    rows, i = base(spark, sf_dir), F.col("i")
    own = _pick(F.floor(i / 3) % 4, "Active", "Past", "Forthcoming", "")
    item = F.to_json(F.struct("symbol", F.col("name").alias("companyName"), own.alias("status"), F.when(i % 2 == 0, F.col("isin")).alias("isin"), F.date_format("d", "dd-MMM-yyyy").alias("ipoStartDate"), F.concat(F.lit("Rs."), _text("low"), F.lit(" to Rs."), _text("high")).alias("priceRange")))
    lists = rows.select(((i % 3) * 1_000_000_000 + i).alias("ord"), _pick(i % 3, "current", "upcoming", "past").alias("bucket"), item.alias("payload"))
    found = rows.where("symbol is not null and i % 4 < 3").groupBy(F.col("symbol").alias("id")).agg(F.min("i").alias("i"), F.min("d").alias("d"))
    meta = F.struct(F.struct(F.concat(F.lit("IND"), _text("i")).alias("isin"), F.date_format("d", "dd-MMM-yyyy").alias("listingDate")).alias("metaInfo"))
    details = found.select("id", F.to_json(meta).alias("payload"))
    return _shown(scans.nse(lists, details), F.get_json_object(F.col("raw_sources.nse"), "$.details.metaInfo.isin").alias("detail_isin"))


@query(f"""WITH {BASE}, l AS (SELECT (i % 3) * 1000000000 + i AS ord, ['open', 'upcoming', 'closed'][1 + i % 3] AS bucket, i, CASE WHEN i % 4 <> 0 THEN 'g' || (i // 2) END AS sid, isin, symbol, name, d, low FROM base),
k AS (SELECT *, coalesce(sid, isin, symbol) AS key FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS n FROM k WHERE key IS NOT NULL),
t AS (SELECT 'g' || i AS did, i AS di FROM base WHERE i % 3 = 0),
m AS (SELECT f.*, di, CASE di % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' WHEN 2 THEN 'listed' WHEN 3 THEN 'upcoming' ELSE bucket END AS status FROM f LEFT JOIN t ON sid = did WHERE n = 1)
SELECT {2 * RANK} + ord AS ord, isin, symbol, coalesce('Short ' || di, name) AS company_name, status, strftime(d, '%Y-%m-%d') AS bidding_start_date, NULL::VARCHAR AS listing_date, low::DOUBLE AS low,
CASE WHEN status <> 'upcoming' THEN 'https://docs.example.com/' || di || '.pdf' END AS rhp, CASE WHEN status = 'upcoming' THEN 'https://docs.example.com/' || di || '.pdf' END AS drhp,
sid AS search_id, 'https://docs.example.com/' || di || '.pdf' AS document_url, false AS has_list FROM m WHERE status <> 'listed'""")
def q_scan_groww(spark, sf_dir):
    """All documents in three lists, some with the search id of another; details for a third; documents only."""
    rows, i = base(spark, sf_dir), F.col("i")
    item = F.to_json(F.struct("symbol", "isin", F.col("name").alias("companyName"), F.when(i % 4 != 0, F.concat(F.lit("g"), F.floor(i / 2).cast("string"))).alias("searchId"),
                              (F.unix_date("d").cast("long") * 86_400_000).alias("bidStartTimestamp"), F.array(F.struct(F.col("low").cast("double").alias("minPrice"))).alias("categories")))
    lists = rows.select(((i % 3) * 1_000_000_000 + i).alias("ord"), _pick(i % 3, "open", "upcoming", "closed").alias("bucket"), item.alias("payload"))
    detail = F.to_json(F.struct(_pick(i % 4, "ACTIVE", "CLOSED", "LISTED", "PRE_APPLY").alias("status"), F.concat(F.lit("Short "), _text("i")).alias("companyShortName"), F.concat(F.lit("https://docs.example.com/"), _text("i"), F.lit(".pdf")).alias("documentUrl")))
    details = rows.where("i % 3 = 0").select(F.concat(F.lit("g"), _text("i")).alias("id"), detail.alias("payload"))
    raw = F.col("raw_sources.groww")
    more = [F.get_json_object(raw, "$.searchId").alias("search_id"), F.get_json_object(raw, "$.documentUrl").alias("document_url"), F.get_json_object(raw, "$.list").isNotNull().alias("has_list")]
    return _shown(scans.groww(lists, details, docs_only=True), *more)


@query(f"""WITH {BASE}, f AS (SELECT *, min(i) OVER (PARTITION BY i // 2) = i AS first FROM base),
m AS (SELECT *, CASE WHEN d + 12 < DATE '{TODAY}' THEN 'listed' WHEN d < DATE '{TODAY}' THEN 'closed' WHEN d > DATE '{TODAY}' THEN 'upcoming' ELSE 'open' END AS status FROM f WHERE first)
SELECT {3 * RANK} + row_number() OVER (ORDER BY i) - 1 AS ord, NULL::VARCHAR AS isin, symbol, trim(name) AS company_name, status, strftime(d, '%Y-%m-%d') AS bidding_start_date, strftime(d + 12, '%Y-%m-%d') AS listing_date, low::DOUBLE AS low,
CASE WHEN i % 8 = 0 THEN '/files/' || i || '-rhp.pdf' END AS rhp, CASE WHEN i % 8 = 2 THEN '/files/' || i || '-draft.pdf' END AS drhp FROM m WHERE status <> 'listed'""")
def q_scan_zerodha(spark, sf_dir):
    """A list page for each document, two of them with the same detail page; detail pages with a prospectus for half of them."""
    rows, i = base(spark, sf_dir), F.col("i")
    path = F.concat(F.lit("/ipo/"), F.floor(i / 2).cast("string"), F.lit("/"))
    escaped = F.replace(F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cell = lambda kind, *inside: [F.lit(f'<td class="{kind}">'), *inside, F.lit("</td>")]
    bidding = [F.date_format("d", "dd"), F.lit("th – "), F.date_format("d", "dd"), F.lit("th "), F.date_format("d", "MMM yyyy"), F.lit('<span class="hidden">x</span>')]
    page = F.concat(
        F.lit("<table><tr>"), *cell("name", F.lit('<a href="'), path, F.lit('"><span class="ipo-symbol">'), F.coalesce("symbol", F.lit("")), F.lit('</span><span class="ipo-name">'), escaped, F.lit("</span></a>")),
        *cell("date", *bidding), *cell("date", F.date_format(F.date_add("d", 12), "dd-MMM-yyyy")), *cell("text-right", F.lit("₹"), _text("low"), F.lit(" – ₹"), _text("high")), F.lit("</tr></table>"),
    )
    link = F.concat(F.lit('<a href="/x.html">prospectus</a><a href="/files/'), _text("i"), F.when(i % 8 == 0, "-rhp").otherwise("-draft"), F.lit('.pdf">Prospectus</a>'))
    details = rows.where("i % 8 in (0, 2)").select(path.alias("id"), link.alias("html"))
    return _shown(scans.zerodha(rows.select(i.alias("ord"), page.alias("html")), details, TODAY))


@query("""SELECT row_number() OVER (ORDER BY c_custkey, k) - 1 AS ord, c_mktsegment AS bucket, 'g' || c_custkey || '-' || k AS search_id, CASE WHEN k = 1 THEN 'A, "quoted" {name}' END AS name
FROM customer, range(3) t(k) WHERE k <= c_custkey % 3 AND c_custkey % 5 <> 4""")
def q_unpack_lists(spark, sf_dir):
    """An answered page for each customer, with one to three items under one of three members; a fifth hold no list. Pages come by a clock in microseconds."""
    k = F.col("c_custkey")
    item = lambda j, *more: F.concat(F.lit('{"searchId":"g'), _text("c_custkey"), F.lit(f'-{j}"'), *more, F.lit("}"))
    three = [item(0), item(1, F.lit(',"companyName":"A, \\"quoted\\" {name}","categories":[{"minPrice":1.5}]')), item(2)]
    listed = F.concat(F.lit("["), F.array_join(F.slice(F.array(*three), F.lit(1), (k % 3 + 1).cast("int")), ", "), F.lit("]"))
    member = _pick(k % 5, "ipoList", "data", "results", "data", "message")
    page = F.concat(F.lit('{"status": "ok", "'), member, F.lit('": '), F.when(k % 5 == 4, F.lit('"none"')).otherwise(listed), F.lit("}"))
    items = scans.unpack(table(spark, sf_dir, "customer").select((k + 1_700_000_000_000_000).alias("ord"), F.col("c_mktsegment").alias("bucket"), page.alias("payload")))
    return items.select("ord", "bucket", F.get_json_object("payload", "$.searchId").alias("search_id"), F.get_json_object("payload", "$.companyName").alias("name"))
