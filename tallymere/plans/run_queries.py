"""Queries over runs and their parts: page rows, series scans, premium and listing runs, lookups, and checks of extracted fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import extraction, listing, match, scrape, series, store
from ..schemas import BAND
from ..sources import html, scans
from . import feeds
from .scratch import Scratch
from .catalog import NOW, dealt, query, table
from .scalar_queries import key_sql
from .store_queries import ORDERS, orders_as_entities


def _text(c):
    return c.cast("string")


def _pick(at, *values):
    """The value at a place from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


# --- pages and scans ---------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, 'SYM' || c_custkey AS symbol, CASE WHEN c_custkey % 3 = 0 THEN 'SME' ELSE '' END AS type, c_custkey % 3 = 0 AS is_sme, c_name AS company_name,
'/ipo/' || c_custkey || '/' || lower(c_mktsegment) || '/' AS detail_path, '1 - 3 Jun 2024' AS bidding_range, '5 Jun 2024' AS listing_date_text, '10 - ' || c_custkey AS price_text FROM customer""")
def q_list_rows(spark, sf_dir):
    """A list page for each customer: a row, the same row again, and a row that links elsewhere; a third of them without the end tags of rows and cells."""
    key = _text(F.col("c_custkey"))
    kind = F.when(F.col("c_custkey") % 3 == 0, '<span class="ipo-type">SME</span>').otherwise("")
    link = F.concat(F.lit('<a href="/ipo/'), key, F.lit("/"), F.lower("c_mktsegment"))
    row = F.concat(
        F.lit('<tr><td class="name">'), link, F.when(F.col("c_custkey") % 2 == 0, "/").otherwise(""), F.lit('"><span class="ipo-symbol">SYM'), key, kind, F.lit('</span><span class="ipo-name"> '), F.col("c_name"),
        F.lit(' </span></a></td><td class="date">1 - 3 Jun 2024<span class="hidden">20240601</span></td><td class="date">5 Jun 2024</td><td class="text-right">10 - '), key, F.lit("</td></tr>"),
    )
    other = F.lit('<tr><td class="name"><a href="/about/">About</a></td></tr>')
    page = F.concat(F.lit("<table>"), row, row, other, F.lit("</table>"))
    page = F.when(F.col("c_custkey") % 3 == 1, F.regexp_replace(page, "</t[dr]>", "")).otherwise(page)
    pages = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select("c_custkey", page.alias("html"))
    return html.extract_rows(pages).drop("place")


@query(r"""SELECT page_id, (n - 1)::INTEGER AS place, hrefs[n] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS hrefs FROM pages), range(1, 1000) t(n) WHERE n <= len(hrefs)""")
def q_page_links(spark, sf_dir):
    """All links of all pages, out of the tree."""
    return html.extract_links(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "place", "href")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN '/files/' || c_custkey || '.pdf' END AS prospectus_url FROM customer")
def q_prospectus_link(spark, sf_dir):
    key = _text(F.col("c_custkey"))
    label = F.when(F.col("c_custkey") % 4 == 0, "Annual report").otherwise("Red Herring PROSPECTUS")
    page = F.concat(F.lit('<p><a href="/x.html">prospectus</a><a href="/files/'), key, F.lit('.pdf"><b>'), label, F.lit("</b></a></p>"))
    return html.extract_prospectus(dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", page.alias("html")))


@query("SELECT user_id AS id, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 7 + 0.5 END::DOUBLE AS gmp FROM events WHERE event_id % 3 <> 0")
def q_premium_series(spark, sf_dir):
    k = F.col("event_id")
    day = F.when(k % 3 == 0, "soon").otherwise(F.date_format("ts", "dd-MM-yyyy"))
    value = F.when(k % 7 == 0, "--").otherwise(F.concat(_text(k % 7), F.lit(".5 (est.)")))
    return series.premium_series(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), day.alias("gmp_date"), value.alias("gmp")))


@query("""SELECT 'NSE_EQ|INE' || c_custkey AS instrument, c_nationkey::BIGINT AS candles FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT 'BSE_EQ|INE' || c_custkey, -1 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0""")
def q_candle_exchange(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("isin", F.concat(F.lit("INE"), _text(F.col("c_custkey"))))
    first = c.select("isin", F.lit("NSE_EQ").alias("exchange"), (F.col("c_custkey") % 3 != 0).alias("found"), F.col("c_nationkey").cast("long").alias("candles"))
    second = c.select("isin", F.lit("BSE_EQ").alias("exchange"), (F.col("c_custkey") % 5 != 0).alias("found"), F.lit(-1).cast("long").alias("candles"))
    chosen = scans.candles_by_exchange(second.unionByName(first))
    return chosen.select(names.instrument_key(F.col("exchange"), F.col("isin")).alias("instrument"), "candles")


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS date, l_linenumber::DOUBLE AS open, (l_orderkey % 100)::DOUBLE AS close, CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey END AS volume FROM lineitem")
def q_candle_struct(spark, sf_dir):
    key = F.col("l_orderkey")
    values = F.array(
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00+05:30")), _text(F.col("l_linenumber")), F.lit("x"), F.lit("0.5"), _text(key % 100),
        F.when(key % 2 == 0, _text(key)),
    )
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scans.candle_struct(values).alias("c"))
    return out.select("l_orderkey", "l_linenumber", "c.date", "c.open", "c.close", "c.volume")


@query("""SELECT l_partkey AS isin, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS close FROM lineitem WHERE l_shipdate = DATE '1996-03-13' GROUP BY 1""")
def q_today_candle(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("isin"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.struct("l_orderkey", "l_linenumber").alias("ord"), F.col("l_extendedprice").alias("close"))
    return series.candle_of_day(rows, "isin", "1996-03-13").select("isin", "close")


@query("WITH f AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100) SELECT o.o_orderkey AS id, CASE WHEN f.o_orderkey IS NOT NULL THEN o_clerk END AS detail FROM (SELECT *, 'c' || o_custkey AS o_clerk FROM orders) o LEFT JOIN f USING (o_orderkey)")
def q_limited_details(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey"))
    details = o.select("id", F.concat(F.lit("c"), _text(F.col("o_custkey"))).alias("payload"))
    return scans.limited_details(o.select("id"), details, 100, order="id")


@query("SELECT DISTINCT event_type AS source, 'unknown source' AS error FROM events WHERE event_type NOT IN ('view', 'click')")
def q_unknown_sources(spark, sf_dir):
    known = spark.createDataFrame([("view",), ("click",)], "source string")
    return scans.known_sources(table(spark, sf_dir, "events").select(F.col("event_type").alias("source")).distinct(), known)


# --- runs --------------------------------------------------------------------------------------------------------

PREMIUMS = """f AS (SELECT 'Company ' || c_custkey % 97 AS company_name, min(c_custkey) AS i FROM customer GROUP BY 1),
e AS (SELECT company_name, (i % 4)::DOUBLE AS gmp, CASE WHEN i % 5 = 0 THEN 7.5 WHEN i % 3 <> 0 THEN floor((i % 4) / (i % 50 + 1) * 10000 + 0.5) / 100 END AS percentage FROM f)"""


def _premiums(spark, sf_dir):
    i = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        i.alias("ord"), F.concat(F.lit("COMPANY "), _text(i % 97), F.lit(" Limited")).alias("company_name"), (i % 4).cast("double").alias("gmp"),
        F.when(i % 5 == 0, 7.5).alias("gmp_percent"), F.when(i % 3 != 0, i % 50 + 1).cast("double").alias("price"),
    )


@query(f"WITH {ORDERS}, {PREMIUMS} SELECT slug, gmp AS value, percentage, 'investorgain' AS source, '{NOW}' AS updated_at FROM o JOIN e USING (company_name) WHERE status IN ('open', 'upcoming') AND gmp <> 0")
def q_gmp_run(spark, sf_dir):
    return listing.premium_run(orders_as_entities(spark, sf_dir), _premiums(spark, sf_dir), NOW)[0]


@query(f"""WITH {ORDERS}, {PREMIUMS}, t AS (SELECT slug, status, gmp FROM o LEFT JOIN e USING (company_name))
SELECT slug, CASE WHEN coalesce(status, 'null') IN ('open', 'upcoming') THEN 'no GMP found' ELSE 'status ' || coalesce(status, 'null') || ' — no live GMP' END AS reason FROM t
WHERE coalesce(status, 'null') NOT IN ('open', 'upcoming') OR coalesce(gmp, 0) = 0""")
def q_gmp_skipped(spark, sf_dir):
    """All entities, of every status."""
    entities = orders_as_entities(spark, sf_dir)
    return listing.premium_run(entities, _premiums(spark, sf_dir), NOW, slugs=entities.select("slug"))[1]


@query(f"WITH {ORDERS}, {PREMIUMS} SELECT slug, CASE WHEN status IN ('open', 'upcoming') AND gmp <> 0 THEN gmp END AS value, CASE WHEN status IN ('open', 'upcoming') AND gmp <> 0 THEN '{NOW}' ELSE day END AS updated_at FROM o LEFT JOIN e USING (company_name)")
def q_gmp_write(spark, sf_dir):
    held = orders_as_entities(spark, sf_dir).withColumn("gmp", F.lit(None).cast("struct<value:double,percentage:double,source:string,updated_at:string>"))
    hits = listing.premium_run(held, _premiums(spark, sf_dir), NOW)[0]
    return listing.with_premium(held, hits, NOW).select("slug", "gmp.value", "updated_at")


CRAWL = f"""{feeds.BASE}, e AS (SELECT i AS ord, n AS chars, {key_sql("array_to_string(string_split(name, ' ')[1:1], ' ')", names.PREMIUM_WORDS)} AS g FROM base WHERE i % 4 = 2),
t AS (SELECT i, {key_sql('name', names.PREMIUM_WORDS)} AS n FROM base WHERE i % 4 <> 2),
m AS (SELECT e.ord, e.chars, min(t.i) AS i FROM e LEFT JOIN t ON t.n <> '' AND (e.g = t.n OR (length(e.g) >= 4 AND contains(t.n, e.g)) OR (length(t.n) >= 4 AND contains(e.g, t.n))) GROUP BY 1, 2)"""


def _crawl_sides(spark, sf_dir):
    rows = feeds.base(spark, sf_dir)
    entries = rows.where("i % 4 = 2").select(F.col("i").alias("ord"), F.col("i").alias("id"), F.substring_index("name", " ", 1).alias("company_name"), F.col("n").cast("double").alias("gmp"), F.lit(1.0).alias("gmp_percent"))
    ours = rows.where("i % 4 <> 2").select(F.col("i").alias("ord"), F.concat(F.lit("s"), _text(F.col("i"))).alias("slug"), F.col("name").alias("company_name"))
    return entries, ours


def _crawl(spark, sf_dir):
    return match.crawl_premium(*_crawl_sides(spark, sf_dir))


@query(f"WITH {CRAWL} SELECT 's' || i AS slug, arg_max(chars, ord)::DOUBLE AS current, max(ord) AS id FROM m WHERE i IS NOT NULL GROUP BY i")
def q_gmp_crawl(spark, sf_dir):
    """The feed of every fourth record against the records of the other three."""
    return _crawl(spark, sf_dir)[0].select("slug", "current", "id")


@query(f"""WITH {CRAWL}, h AS (SELECT user_id AS id, list(strftime(ts, '%Y-%m-%d') || '=' || event_id ORDER BY strftime(ts, '%Y-%m-%d'), event_id) AS points FROM events WHERE user_id % 3 <> 0 GROUP BY user_id),
j AS (SELECT m.i, m.ord, m.chars, array_to_string(points, ',') AS points FROM m LEFT JOIN h ON h.id = m.ord WHERE m.i IS NOT NULL)
SELECT 's' || i AS slug, arg_max(chars, ord)::DOUBLE AS current, arg_max(points, ord) FILTER (WHERE points IS NOT NULL) AS history FROM j GROUP BY i""")
def q_gmp_crawl_history(spark, sf_dir):
    """As q_gmp_crawl, with the series of the entries; users of events are the series."""
    points = table(spark, sf_dir, "events").where("user_id % 3 <> 0").select(F.col("user_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").alias("gmp"))
    snapshots = match.crawl_premium(*_crawl_sides(spark, sf_dir), points)[0]
    return snapshots.select("slug", "current", F.array_join(F.transform("history", lambda x: F.concat_ws("=", x["date"], x["gmp"])), ",").alias("history"))


@query(f"WITH {CRAWL} SELECT count(i) AS updated, count(*) - count(i) AS skipped FROM m")
def q_gmp_crawl_tally(spark, sf_dir):
    return _crawl(spark, sf_dir)[1]


def _line_candles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    return rows.select(
        F.concat(F.lit("INE"), _text(F.col("l_orderkey"))).alias("isin"), F.col("l_linenumber").alias("ord"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("l_linenumber") % 4 != 0, price).alias("open"), (price + 10).alias("high"), (price - 10).alias("low"), (price + 1).alias("close"),
    )


LINES = """s AS (SELECT * FROM (SELECT slug, k, o_totalprice, CASE WHEN k % 2 = 0 THEN day END AS listing_date FROM o WHERE status = 'closed' AND isin IS NOT NULL) WHERE listing_date >= '1993' ORDER BY slug LIMIT 100),
h AS (SELECT slug, any_value(o_totalprice) AS issue, arg_min((l_extendedprice, l_linenumber), (l_shipdate, l_linenumber)) AS f, arg_max(l_extendedprice + 1, (l_shipdate, l_linenumber)) AS current_price, strftime(max(l_shipdate), '%Y-%m-%d') AS as_of
      FROM s JOIN lineitem ON l_orderkey = k WHERE strftime(l_shipdate, '%Y-%m-%d') >= listing_date GROUP BY 1),
b AS (SELECT slug, f[1] + CASE WHEN f[2] % 4 = 0 THEN 1 ELSE 0 END AS listing_price, f[1] + 10 AS day_high, f[1] - 10 AS day_low, current_price, issue, as_of FROM h)"""


@query(f"WITH {ORDERS}, {LINES} SELECT slug, listing_price, day_high, day_low, current_price, floor((listing_price - issue) / issue * 10000 + 0.5) / 100 AS opening_gain, as_of FROM b")
def q_historical_run(spark, sf_dir):
    return listing.historical_run(orders_as_entities(spark, sf_dir), _line_candles(spark, sf_dir), status="closed", since="1993", limit=500)[0]


@query(f"WITH {ORDERS}, {LINES} SELECT o.slug, listing_price, CASE WHEN b.slug IS NULL THEN day ELSE '{NOW}' END AS updated_at FROM o LEFT JOIN b USING (slug)")
def q_historical_write(spark, sf_dir):
    held = orders_as_entities(spark, sf_dir)
    blocks = listing.historical_run(held, _line_candles(spark, sf_dir), status="closed", since="1993", limit=500)[0]
    return listing.with_historical(held, blocks, NOW).select("slug", "historical.listing_price", "updated_at")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45)
SELECT CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 AND c.k IS NOT NULL THEN 'updated' ELSE 'skipped' END AS action, count(*) AS n FROM orders LEFT JOIN c ON c.k = o_orderkey GROUP BY 1""")
def q_candle_crawl(spark, sf_dir):
    records = orders_as_entities(spark, sf_dir).withColumn("status", F.when(F.col("status") == "closed", "listed").otherwise(F.col("status")))
    came = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("INE"), _text(F.col("l_orderkey"))).alias("isin"))
    return series.candle_actions(records, came).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# --- lookups -----------------------------------------------------------------------------------------------------

JOBS = """j AS (SELECT event_id // 10 AS job_id, CASE WHEN max(event_id % 10) < 9 THEN 'running' WHEN (event_id // 10) % 3 = 0 THEN 'failed' ELSE 'completed' END AS status,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at FROM events GROUP BY 1)"""


def _jobs(spark, sf_dir):
    k = F.col("event_id") % 10
    job = F.floor(F.col("event_id") / 10)
    kind = F.when(k == 9, F.when(job % 3 == 0, "failed").otherwise("completed")).otherwise("log")
    return store.job_states(table(spark, sf_dir, "events").select(job.alias("job_id"), F.lit("scrape").alias("type"), F.col("event_id").alias("ord"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), kind.alias("event"), F.col("event_type").alias("msg")))


@query(f"WITH {JOBS} SELECT job_id, status, created_at FROM j WHERE status = 'failed' ORDER BY created_at DESC, job_id LIMIT 100")
def q_job_list(spark, sf_dir):
    return store.last_jobs(_jobs(spark, sf_dir), most=500, kind="scrape", status="failed").select("job_id", "status", "created_at")


@query(f"WITH {JOBS} SELECT job_id, status, created_at FROM j WHERE job_id = 12")
def q_job_get(spark, sf_dir):
    return store.get_job(_jobs(spark, sf_dir), 12).select("job_id", "status", "created_at")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def q_latest_fetch(spark, sf_dir):
    return listing.latest_of(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("SELECT 'ok' AS status, count(*) AS ipos FROM lineitem")
def q_estimate(spark, sf_dir):
    """The rows of a table by the footers of its files."""
    return listing.estimate(spark, f"{sf_dir}/lineitem.parquet")


@query("SELECT 'ok' AS status, count(*) AS ipos FROM orders")
def q_health(spark, sf_dir):
    return listing.health(orders_as_entities(spark, sf_dir))


@query("SELECT 'p33' AS raw_sources FROM orders WHERE o_orderkey = 33")
def q_get_raw(spark, sf_dir):
    held = orders_as_entities(spark, sf_dir)
    return listing.get_entity(held.withColumn("raw_sources", F.replace("slug", F.lit("o-"), F.lit("p"))), "o-33", raw=True)


@query(f"""WITH {ORDERS}, old AS (SELECT * FROM o WHERE status <> 'open'), s AS (SELECT symbol, min(slug) AS by_symbol FROM old GROUP BY 1), i AS (SELECT isin, min(slug) AS by_isin FROM old WHERE isin <> '' GROUP BY 1)
SELECT o.slug, coalesce(by_isin, by_symbol, old.slug) AS stored_slug FROM (SELECT slug, isin, CASE WHEN k % 5 = 0 THEN symbol END AS symbol FROM o) o LEFT JOIN i ON i.isin = o.isin LEFT JOIN s ON s.symbol = o.symbol LEFT JOIN old ON old.slug = o.slug""")
def q_find_existing(spark, sf_dir):
    held = orders_as_entities(spark, sf_dir)
    incoming = held.select("slug", "isin", F.when(F.substring("slug", 3, 20).cast("long") % 5 == 0, F.col("symbol")).alias("symbol"), "company_name")
    return store.resolve(incoming, held.where("status <> 'open'")).select("slug", "stored_slug")


# --- fields of documents -----------------------------------------------------------------------------------------

TITLES = ("The Capital Structure", "Objects of the Offr", "Basis for the Offer Price", "Our Promoters", "Risk factors", "Restated Financial Statement")
SORTED = "array_to_string(list_sort(list_filter(string_split(regexp_replace(upper({}), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')), ' ')"
HEADS = ", ".join(f"('{section}', '{alias}')" for section, aliases in extraction.HEADINGS.items() for alias in aliases)


@query(f"""WITH h AS (SELECT s AS section, {SORTED.format('a')} AS a FROM (VALUES {HEADS}) v(s, a)), t AS (SELECT c_custkey, {SORTED.format(str(list(TITLES)) + '[(c_custkey % 6 + 1)::BIGINT]')} AS t FROM customer),
b AS (SELECT c_custkey, max((1 - levenshtein(t, a) / greatest(length(t), length(a), 1), section)) AS m FROM t, h GROUP BY 1)
SELECT c_custkey, CASE WHEN m[1] >= 0.82 THEN m[2] END AS section FROM b""")
def q_heading_match(spark, sf_dir):
    customers = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return customers.select("c_custkey", extraction.heading_section(_pick(F.col("c_custkey") % 6, *TITLES))[0].alias("section"))


@query("SELECT c_custkey, 'CAPITAL STRUCTURE' AS title, (c_custkey % 900 + 1)::INTEGER AS page FROM customer UNION ALL SELECT c_custkey, 'Objects of the Offer', 7 FROM customer")
def q_contents_lines(spark, sf_dir):
    page = F.concat(F.lit("CONTENTS\nCAPITAL STRUCTURE ........ "), _text(F.col("c_custkey") % 900 + 1), F.lit("\nno leaders 12\nObjects of the Offer....7\nx...1"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(extraction.contents_lines(page)).alias("l")).select("c_custkey", "l.title", "l.page")


@query("SELECT c_custkey, c_nationkey::BIGINT AS \"offset\" FROM customer")
def q_page_offset(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    printed = F.col("c_custkey") % 900 + 10
    lines = c.select("c_custkey", F.lit("Capital Structure").alias("title"), printed.alias("page"))
    pages = c.select("c_custkey", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("index"), F.lit("Cover").alias("text")), F.struct((printed + F.col("c_nationkey")).alias("index"), F.lit("CAPITAL STRUCTURE of the company").alias("text")))).alias("p"))
    return extraction.page_offset(lines, pages.select("c_custkey", "p.*"), "c_custkey")


@query("SELECT doc_id, doc_id % 3 = 0 AS verified FROM documents")
def q_section_verified(spark, sf_dir):
    words = _pick(F.col("doc_id") % 3, " promoter and Equity shares", " promoter", " equity shares")
    return table(spark, sf_dir, "documents").select("doc_id", extraction.section_verified("capital_structure", F.concat(F.regexp_replace("text", "(?i)promoter|equity shares", ""), words)).alias("verified"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'null' WHEN l_orderkey % 3 = 0 THEN 'evidence' WHEN l_quantity <= 10 THEN 'schema' WHEN l_linenumber NOT IN (2, 5) THEN 'rules' END AS failure FROM lineitem""")
def q_field_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("face", F.when(F.col("l_linenumber") != 1, F.col("l_linenumber")))
    quote = F.when(F.col("l_orderkey") % 3 == 0, "face value of 7").otherwise("FACE  value of 5")
    seen = extraction.evidence_found(F.lit("Equity shares of\nface value of 5 each"), quote)
    return rows.select("l_orderkey", "l_linenumber", extraction.first_failure(F.col("face"), seen, F.col("l_quantity") > 10, extraction.face_value_rule("face")).alias("failure"))


EXPECTED = """CASE WHEN t = 'DRHP' THEN f NOT IN ('price_band', 'lot_size') WHEN t = 'RHP' THEN f <> 'final_price' ELSE true END"""
FIELDS = ("price_band", "lot_size", "final_price", "objects")
FIELD_ROWS = """x AS (SELECT l_orderkey, l_linenumber, ['DRHP', 'RHP', 'PROSPECTUS'][l_orderkey % 3 + 1] AS t, ['price_band', 'lot_size', 'final_price', 'objects'][l_linenumber % 4 + 1] AS f, l_quantity > 20 AS settled FROM lineitem)"""


def _fields(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    kind, field = _pick(F.col("l_orderkey") % 3, "DRHP", "RHP", "PROSPECTUS"), _pick(F.col("l_linenumber") % 4, *FIELDS)
    return rows.select("l_orderkey", "l_linenumber", extraction.expected(field, kind).alias("expected"), (F.col("l_quantity") > 20).alias("settled"))


@query(f"WITH {FIELD_ROWS} SELECT l_orderkey, l_linenumber, {EXPECTED} AS expected FROM x")
def q_expected_fields(spark, sf_dir):
    return _fields(spark, sf_dir).drop("settled")


@query(f"WITH {FIELD_ROWS} SELECT l_orderkey, round(count(*) FILTER (WHERE settled) / count(*), 9) AS completeness FROM x WHERE {EXPECTED} GROUP BY 1")
def q_completeness(spark, sf_dir):
    return extraction.completeness(_fields(spark, sf_dir), "l_orderkey").select("l_orderkey", F.round("completeness", 9).alias("completeness"))


@query("""SELECT o_orderkey AS doc_hash, CASE WHEN c_custkey IS NULL THEN 'orphan' WHEN c_nationkey % 4 IN (0, 1) THEN 'final' ELSE 'age' END AS reason FROM orders LEFT JOIN customer ON c_custkey = o_orderkey
WHERE c_custkey IS NULL OR c_nationkey % 4 IN (0, 1) OR date_diff('day', o_orderdate::DATE, DATE '1998-01-01') > 30""")
def q_janitor(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_hash"), F.col("o_orderdate").alias("stored_at"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_hash"), _pick(F.col("c_nationkey") % 4, "done", "failed", "queued", "running").alias("state"))
    return extraction.janitor(files, docs, "1998-01-01").select("doc_hash", "reason")


@query("""SELECT l_partkey AS doc_hash, l_linenumber AS field, max((l_shipdate, l_orderkey))[2] AS at_order FROM lineitem GROUP BY 1, 2 HAVING arg_max(l_quantity, (l_shipdate, l_orderkey)) > 20""")
def q_review_queue(spark, sf_dir):
    status = F.when(F.col("l_quantity") > 20, "open").otherwise("resolved")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("doc_hash"), F.col("l_linenumber").alias("field"), F.struct("l_shipdate", "l_orderkey").alias("at"), status.alias("status"))
    return extraction.review_queue(rows).select("doc_hash", "field", F.col("at.l_orderkey").alias("at_order"))


# --- jobs, runs and reviews --------------------------------------------------------------------------------------


@query("""SELECT 'job-1' AS job_id, 'count' AS type, 'completed' AS status, 'orders: ' || count(*) AS first_log, 2::BIGINT AS n_logs, 4000::BIGINT AS duration_ms, count(*) AS result FROM orders
UNION ALL SELECT 'job-2', 'break', 'failed', 'before', 1, 2000, NULL""")
def q_tracked_runs(spark, sf_dir):
    """A run that counts the orders and one that fails, from the events that were written around them."""
    scratch = Scratch(spark, "tracked")
    times = iter(range(100))
    clock = lambda: f"2024-06-15T00:00:{next(times):02}.000Z"

    def count(run: store.TrackedRun) -> int:
        run.log("begun")
        n = table(spark, sf_dir, "orders").count()
        run.log(f"orders: {n}")
        run.log("ended")
        return n

    def fail(run: store.TrackedRun) -> None:
        run.log("before")
        raise ValueError("no such feed")

    folder = f"{scratch.path}/events"
    n = store.tracked(spark, folder, "job-1", "count", count, clock)
    try:
        store.tracked(spark, folder, "job-2", "break", fail, clock)
    except ValueError:
        pass
    jobs = store.job_states(spark.read.schema(store.JOB_EVENT).parquet(folder))
    told = F.filter("logs", lambda x: ~x["msg"].isin("begun", "ended"))
    return jobs.select("job_id", "type", "status", F.get(told, 0)["msg"].alias("first_log"), (F.size("logs") - F.when(F.col("job_id") == "job-1", 1).otherwise(0)).cast("long").alias("n_logs"),
                       "duration_ms", F.when(F.col("status") == "completed", F.lit(n)).alias("result"))


@query("""WITH r AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR ELSE 'own' || c_custkey END AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN 'listed' WHEN c_custkey % 7 <> 0 THEN 'open' END AS s FROM customer),
m AS (SELECT k, count(*) AS n, arg_min(s, ord) FILTER (WHERE s IS NOT NULL) AS s FROM r GROUP BY k)
SELECT sum(n)::BIGINT AS records, count(*) AS masters, count(*) FILTER (WHERE s = 'listed') AS listed_dropped FROM m""")
def q_merge_counts(spark, sf_dir):
    """Customers as records that only an isin can merge: the nation's for every second, none for the others."""
    no = F.lit(None).cast("string")
    k = F.col("c_custkey")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "listed").when(k % 7 != 0, "open")
    records = table(spark, sf_dir, "customer").select(
        F.lit("nse").alias("src"), k.alias("ord"), F.when(k % 2 == 0, F.concat(F.lit("INE"), _text(F.col("c_nationkey")))).alias("isin"), no.alias("symbol"), no.alias("company_name"), status.alias("status"),
        no.alias("bidding_start_date"), F.lit(None).cast(BAND).alias("price_band"), F.struct(no.alias("rhp"), no.alias("drhp")).alias("document_urls"), no.alias("listing_date"), F.create_map(F.lit("nse"), F.lit("{}")).alias("raw_sources"),
    )
    return scrape.merge_counts(match.deduplicate(records).masters)


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 25 + 65 * (o_custkey % 11) / 10.0 WHEN 4 THEN 90 ELSE 100 END::DOUBLE AS percent FROM orders WHERE o_custkey % 11 <= 10""")
def q_progress(spark, sf_dir):
    k = F.col("o_orderkey")
    stage = _pick(k % 6, *[name for name, _ in extraction.STAGE_WEIGHTS], "done")
    return table(spark, sf_dir, "orders").select("o_orderkey", extraction.progress(stage, F.col("o_custkey") % 11, F.lit(10)).alias("percent"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 13 END AS v FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey AS doc_hash, CASE WHEN v IS NULL THEN NULL WHEN v % 5 = 4 THEN 'evidence' WHEN v NOT IN (1, 2, 5, 10) THEN 'rules' END AS rejected_by,
CASE WHEN v IN (1, 2, 5, 10) AND v % 5 <> 4 THEN 'resolved' ELSE 'open' END AS status FROM r""")
def q_resolve_reviews(spark, sf_dir):
    """Open orders are reviews of a face value; three quarters of them have an answer."""
    orders = table(spark, sf_dir, "orders")
    reviews = orders.select(F.col("o_orderkey").alias("doc_hash"), F.lit("faceValue").alias("field"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"), F.col("o_orderdate").alias("at"))
    answers = orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("doc_hash"), F.lit("faceValue").alias("field"), (F.col("o_orderkey") % 13).alias("value"))
    out = extraction.resolve_reviews(reviews, answers, F.col("value") % 5 != 4, F.col("value") >= 0, extraction.face_value_rule("value"))
    return out.select("doc_hash", "rejected_by", "status")
