"""Queries over series and the entity store, and those of document extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import buckets, extraction, listing, pages, scrape, search, series, store
from . import feeds
from .catalog import NOW, query, table
from .record_queries import entities
from .scratch import Scratch

# --- series ------------------------------------------------------------------------------------------------------

CANDLES = """
c AS (SELECT user_id AS isin, strftime(ts, '%Y-%m-%d') AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
      FROM events GROUP BY 1, 2)"""


def candles(spark, sf_dir):
    """Daily candles: an instrument for each user, a trade for each event."""
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("isin"), F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume")
    )


@query(f"WITH {CANDLES} SELECT * FROM c")
def q_candles(spark, sf_dir):
    return candles(spark, sf_dir)


@query(f"""WITH {CANDLES}, f AS (SELECT isin, arg_min(open, date) AS o, arg_min(high, date) AS h, arg_min(low, date) AS l, arg_max(close, date) AS k, max(date) AS as_of FROM c GROUP BY 1)
SELECT isin, o AS listing_price, h AS day_high, l AS day_low, k AS current_price, floor((o - (isin % 50 + 1)) / (isin % 50 + 1) * 10000 + 0.5) / 100 AS opening_gain, as_of FROM f""")
def q_historical(spark, sf_dir):
    rows = candles(spark, sf_dir).withColumn("ord", F.lit(0))
    return series.historical(rows, "isin", (F.col("isin") % 50 + 1).cast("double"))


@query(f"""WITH {CANDLES}, m AS (SELECT isin, date, CASE WHEN date >= '2024-01-10' THEN close + 1 ELSE close END AS close FROM c) SELECT isin, count(*) AS days, min(date) AS first_day, arg_max(close, date) AS last_close FROM m GROUP BY 1""")
def q_candle_merge(spark, sf_dir):
    stored = candles(spark, sf_dir).withColumns({"ord": F.lit(0), "oi": F.lit(0).cast("long")})
    incoming = stored.where("date >= '2024-01-10'").withColumn("close", F.col("close") + 1)
    out = series.merge_candles(stored, incoming)
    last = F.element_at("candles", -1)
    return out.select("isin", F.size("candles").cast("long").alias("days"), F.get("candles", 0)["date"].alias("first_day"), last["close"].alias("last_close"))


POINTS = "SELECT user_id AS slug, strftime(ts, '%Y-%m-%d') AS date, value, event_id AS ord, event_type FROM events"


def _points(spark, sf_dir, kinds):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds))
    return e.select(F.col("user_id").alias("slug"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "value", F.col("event_id").alias("ord"))


def _stored_points(spark, sf_dir):
    return series.latest_of_day(_points(spark, sf_dir, STORED)).select("slug", "date", "value", F.lit("investorgain").alias("source"), F.lit("before").alias("updated_at"))


STORED, COMING = ("click", "view"), ("purchase",)
LAST = "SELECT slug, date, arg_max(value, ord) AS value FROM p WHERE event_type IN ({}) GROUP BY 1, 2"
TWO = f"p AS ({POINTS}), old AS ({LAST.format(', '.join(repr(x) for x in STORED))}), new AS ({LAST.format(repr(COMING[0]))})"


@query(f"WITH {TWO} SELECT slug, date, value, 'investorgain' AS source, '{NOW}' AS updated_at FROM new UNION ALL SELECT slug, date, value, 'investorgain', 'before' FROM old ANTI JOIN new USING (slug, date)")
def q_gmp_upsert(spark, sf_dir):
    return series.upsert_points(_stored_points(spark, sf_dir), _points(spark, sf_dir, COMING), NOW)


@query(f"WITH {TWO} SELECT slug, count(*) AS added FROM new ANTI JOIN old USING (slug, date) GROUP BY 1")
def q_gmp_new_points(spark, sf_dir):
    return series.new_points(_stored_points(spark, sf_dir), _points(spark, sf_dir, COMING))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size::DOUBLE WHEN p_size % 4 = 1 THEN NULL ELSE floor(p_size / p_retailprice * 10000 + 0.5) / 100 END AS percentage FROM part")
def q_gmp_percentage(spark, sf_dir):
    from ..functions.numbers import premium_percentage

    size = F.col("p_size").cast("double")
    given, price = F.when(F.col("p_size") % 4 == 0, size), F.when(F.col("p_size") % 4 == 1, F.lit(0.0)).otherwise(F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", premium_percentage(given, size, price).alias("percentage"))


# --- the store ---------------------------------------------------------------------------------------------------


def stored(spark, sf_dir):
    """A store: entities of the feeds' records, keyed by record."""
    one = entities(spark, sf_dir).withColumn("slug", F.concat("slug", F.lit("-"), F.xxhash64("raw_sources.upstox", "raw_sources.nse", "raw_sources.groww", "raw_sources.zerodha").cast("string")))
    return Scratch(spark, "stored").save(one.withColumn("created_at", F.concat(F.lit("2024-01-"), F.lpad((F.length("slug") % 28 + 1).cast("string"), 2, "0"))), "entities")


def orders_as_entities(spark, sf_dir):
    """A large store of few columns: one entity an order."""
    o = table(spark, sf_dir, "orders")
    entry = F.struct(F.lit(NOW).alias("last_fetched"), F.lit(None).cast("string").alias("url"))
    document = F.struct(F.lit("u").alias("url"), F.lit("nse").alias("source"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("slug"), F.concat(F.lit("Company "), (F.col("o_custkey") % 97).cast("string")).alias("company_name"),
        F.lit(None).cast("string").alias("display_name"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("INE"), F.col("o_orderkey").cast("string"))).alias("isin"),
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("symbol"), F.element_at(F.create_map(*[F.lit(x) for x in ("O", "open", "F", "closed", "P", "upcoming")]), F.col("o_orderstatus")).alias("status"),
        F.lit(None).cast("string").alias("issue_type"), F.struct(F.col("o_totalprice").alias("min"), F.col("o_totalprice").alias("max")).alias("price_band"), F.lit(1.0).alias("lot_size"), F.col("o_totalprice").alias("issue_size"),
        F.lit(None).cast("double").alias("issue_price"), F.when(F.col("o_orderkey") % 11 != 0, day).alias("bidding_start"), day.alias("bidding_end"), F.when(F.col("o_orderkey") % 2 == 0, day).alias("listing_date"), F.lit(None).cast("string").alias("sector"),
        F.map_from_arrays(F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("nse"))).otherwise(F.array(F.lit("groww"), F.lit("upstox"))), F.when(F.col("o_orderkey") % 4 == 0, F.array(entry)).otherwise(F.array(entry, entry))).alias("sources"),
        F.when(F.col("o_orderkey") % 5 == 0, F.create_map(F.lit("rhp"), document)).otherwise(F.create_map(F.lit("drhp"), document)).alias("documents"),
        F.lit(None).cast("struct<value:double>").alias("gmp"), day.alias("updated_at"), day.alias("created_at"),
    )


ORDERS = """o AS (SELECT 'o-' || o_orderkey AS slug, 'Company ' || o_custkey % 97 AS company_name, CASE WHEN o_orderkey % 3 = 0 THEN 'INE' || o_orderkey END AS isin, 'S' || o_custkey AS symbol,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' WHEN 'P' THEN 'upcoming' END AS status, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS k,
  CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS bidding_start FROM orders)"""
CARD = ["slug", "company_name", "isin", "symbol", "status", "bidding_start"]
CARD_SQL = ", ".join(CARD)
LATEST = "ORDER BY bidding_start DESC NULLS LAST, day DESC, slug"


@query(f"WITH {ORDERS} SELECT {CARD_SQL} FROM o {LATEST} LIMIT 50 OFFSET 5000")
def q_page_seek(spark, sf_dir):
    """A deep page of all orders, by its place in a copy in the listing's order."""
    path = Scratch(spark, "page-seek").path
    pages.write_pages(orders_as_entities(spark, sf_dir).drop("documents", "sources", "gmp", "price_band"), path)
    return pages.page_at(spark, path, page=101).select(*CARD)


@query(f"WITH {ORDERS} SELECT {CARD_SQL} FROM o {LATEST} LIMIT 50")
def q_list_default(spark, sf_dir):
    return listing.list_entities(orders_as_entities(spark, sf_dir)).select(*CARD)


@query(f"WITH {ORDERS} SELECT {CARD_SQL} FROM o WHERE regexp_matches(company_name, '(?i)company 1.$') OR regexp_matches(symbol, '(?i)company 1.$') OR coalesce(regexp_matches(isin, '(?i)company 1.$'), false) ORDER BY company_name DESC, slug LIMIT 200")
def q_list_search(spark, sf_dir):
    return listing.list_entities(orders_as_entities(spark, sf_dir), search="COMPANY 1.$", sort="name", limit=999).select(*CARD)


@query(f"WITH {ORDERS} SELECT {CARD_SQL} FROM o WHERE k % 4 = 0 AND status = 'open' ORDER BY day, day DESC, slug LIMIT 50")
def q_list_by_source(spark, sf_dir):
    return listing.list_entities(orders_as_entities(spark, sf_dir), status="open", source="nse", sort="createdAt", order="asc").select(*CARD)


@query(f"WITH {ORDERS} SELECT {CARD_SQL} FROM o WHERE k % 5 = 0 ORDER BY CASE WHEN k % 2 = 0 THEN day END DESC NULLS LAST, day DESC, slug LIMIT 20 OFFSET 40")
def q_list_by_document(spark, sf_dir):
    return listing.list_entities(orders_as_entities(spark, sf_dir), document="rhp", sort="listingDate", page=3, limit=20).select(*CARD)


@query(f"WITH {ORDERS} SELECT {CARD_SQL} FROM o {LATEST} LIMIT 1 OFFSET 1")
def q_list_page(spark, sf_dir):
    return listing.list_entities(orders_as_entities(spark, sf_dir), page="2", limit="-3").select(*CARD)


@query(f"WITH {ORDERS} SELECT count(*) AS total, count(*) > 100 AS has_more FROM o WHERE status = 'open'")
def q_list_count(spark, sf_dir):
    return listing.count_entities(orders_as_entities(spark, sf_dir), page=2, limit=50, status="open")


@query(f"WITH {ORDERS} SELECT slug, CASE WHEN k % 4 = 0 THEN 'nse' ELSE 'groww,upstox' END AS sources, NULL::DOUBLE AS gmp FROM o")
def q_card(spark, sf_dir):
    from ..operators.entity import to_cards

    cards = to_cards(orders_as_entities(spark, sf_dir))
    return cards.select("slug", F.array_join(F.array_sort("sources"), ",").alias("sources"), "gmp")


@query(f"WITH {ORDERS} SELECT {CARD_SQL} FROM o WHERE slug = 'o-33'")
def q_get(spark, sf_dir):
    return listing.get_entity(orders_as_entities(spark, sf_dir).withColumn("raw_sources", F.lit("x")), "o-33").select(*CARD)


@query(f"""WITH n AS (SELECT source, count(*) AS ipos FROM (SELECT unnest(CASE WHEN o_orderkey % 4 = 0 THEN ['nse'] ELSE ['groww', 'upstox'] END) AS source FROM orders) GROUP BY 1)
SELECT s.source, coalesce(ipos, 0) AS ipos, coalesce(ipos, 0) > 0 AS healthy, CASE WHEN ipos > 0 THEN '{NOW}' END AS last_fetched FROM (VALUES ('nse'), ('bse'), ('upstox'), ('groww'), ('zerodha'), ('investorgain')) s(source) LEFT JOIN n USING (source)""")
def q_source_health(spark, sf_dir):
    return listing.source_health(orders_as_entities(spark, sf_dir))


@query(f"WITH p AS ({POINTS}) SELECT slug, date, max(value) AS value FROM p WHERE slug = 7 GROUP BY 1, 2 ORDER BY date DESC LIMIT 500")
def q_history(spark, sf_dir):
    points = table(spark, sf_dir, "events").select(F.col("user_id").alias("slug"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "value")
    return listing.premium_history(points.groupBy("slug", "date").agg(F.max("value").alias("value")), 7)


def _run(spark, sf_dir):
    """A store of about two thirds of the entities meets a batch of all of them, some with another status, all with their isin and symbol."""
    state = stored(spark, sf_dir)
    old = state.where(F.pmod(F.crc32("slug"), F.lit(3)) != 0)
    return old, state.drop("created_at").withColumn("status", F.when(F.length("slug") % 5 == 0, "withdrawn").otherwise(F.col("status")))


@query()
def q_upsert_actions(spark, sf_dir):
    old, batch = _run(spark, sf_dir)
    return store.upsert(old, batch, NOW)[1].select("slug", "action", F.array_join("changes", ",").alias("changes"))


@query()
def q_scrape_run(spark, sf_dir):
    """A whole run into an empty store, as cards."""
    from ..operators.entity import to_cards

    run = scrape.run_feeds(feeds.feeds(spark, sf_dir), None, NOW, feeds.TODAY)
    return to_cards(run.state).select("slug", "company_name", "isin", "symbol", "status", "issue_type", "bidding_start", "bidding_end", "listing_date", F.array_join(F.array_sort("sources"), ",").alias("sources"))


@query()
def q_scrape_tally(spark, sf_dir):
    old, batch = _run(spark, sf_dir)
    return store.tally(store.upsert(old, batch, NOW)[1])


@query(f"""WITH {ORDERS} SELECT slug, 'any' AS pattern FROM o WHERE regexp_matches(company_name, '(?i)pany (9[0-6]|1)$') UNION ALL SELECT slug, 'one' FROM o WHERE regexp_matches(isin, '(?i)ine77.*5$')""")
def q_gram_search(spark, sf_dir):
    """All orders, searched by two patterns through the index of three-character runs."""
    rows = orders_as_entities(spark, sf_dir).drop("documents", "sources", "gmp", "price_band")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    scratch = Scratch(spark, "gram-search")
    own = buckets.BucketStore(spark, f"{scratch.path}/store", fields)
    own.replace_all(rows)
    search.write_index(own.entities(), f"{scratch.path}/index")
    found = {name: search.search(own, f"{scratch.path}/index", pattern) for name, pattern in (("any", "pany (9[0-6]|1)$"), ("one", "ine77.*5$"))}
    return found["any"].select("slug", F.lit("any").alias("pattern")).union(found["one"].select("slug", F.lit("one")))


@query(f"""WITH {ORDERS} SELECT CASE WHEN k % 3 = 0 AND k % 5 = 0 THEN 'x-' || k ELSE slug END AS slug, CASE WHEN k % 3 = 0 THEN 'new' WHEN k % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS action,
CASE WHEN k % 7 = 0 THEN 'withdrawn' ELSE status END AS status FROM o""")
def q_bucket_upsert(spark, sf_dir):
    """All orders meet a store in buckets that holds two thirds of them, a fifth under another slug, so that their isin has to find them."""
    kind = "map<string,struct<url:string,source:string,status:string,markdown_url:string,page_hashes:array<string>>>"
    rows = orders_as_entities(spark, sf_dir).withColumn("k", F.substring_index("slug", "-", -1).cast("long")).withColumns({
        "isin": F.concat(F.lit("INE"), "k"), "symbol": F.lit(None).cast("string"), "documents": F.lit(None).cast(kind), "subscription": F.lit(None).cast("struct<retail:double>"), "raw_sources": F.lit(None).cast("map<string,string>")
    })
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("k").schema.fields)
    own = buckets.BucketStore(spark, f"{Scratch(spark, 'bucket-store').path}/store", fields)
    own.upsert(rows.where("k % 3 <> 0").drop("k", "created_at"), NOW)
    slug = F.when(F.col("k") % 5 == 0, F.concat(F.lit("x-"), "k")).otherwise(F.col("slug"))
    batch = rows.withColumns({"slug": slug, "status": F.when(F.col("k") % 7 == 0, "withdrawn").otherwise(F.col("status"))}).drop("k", "created_at")
    actions = own.upsert(batch, NOW)
    return actions.select("slug", "action").join(own.entities().select("slug", "status"), "slug")


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'status' END, CASE WHEN o_totalprice > 100000 THEN 'issue_size' END, CASE WHEN o_orderkey % 4 = 0 THEN 'documents' END) AS changes FROM orders""")
def q_diff_fields(spark, sf_dir):
    k = F.col("o_orderkey")
    a = F.struct(F.lit("open").alias("status"), F.col("o_totalprice").alias("issue_size"), F.create_map(F.lit("rhp"), F.lit("u"), F.lit("drhp"), F.lit("v")).alias("documents"))
    b = F.struct(F.when(k % 3 == 0, "closed").otherwise("open").alias("status"), F.least("o_totalprice", F.lit(100000.0)).alias("issue_size"), F.when(k % 4 == 0, F.create_map(F.lit("rhp"), F.lit("w"), F.lit("drhp"), F.lit("v"))).otherwise(F.create_map(F.lit("drhp"), F.lit("v"), F.lit("rhp"), F.lit("u"))).alias("documents"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))
    return rows.select("o_orderkey", F.array_join(store.changed_fields("a", "b", ("status", "issue_size", "documents")), ",").alias("changes"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS text_value, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice ELSE 0 END AS number_value FROM orders""")
def q_prefer_incoming(spark, sf_dir):
    k = F.col("o_orderkey")
    text = store.prefer_incoming(F.col("o_orderstatus"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")), True)
    number = store.prefer_incoming(F.col("o_totalprice"), F.when(k % 5 == 0, None).otherwise(0.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text_value"), number.alias("number_value"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'u2' ELSE 'u' END AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'nse' ELSE 'groww' END AS source, 'done' AS status, 'm' AS markdown_url FROM orders""")
def q_doc_merge(spark, sf_dir):
    from ..operators.entity import DOCUMENT

    k = F.col("o_orderkey")
    entry = lambda url, source, status, markdown: F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("url", "source", "status", "markdown_url"), (url, source, status, markdown), strict=True)], F.lit(None).cast("array<string>").alias("page_hashes"))
    old = F.create_map(F.lit("rhp"), entry("u", "groww", "done", "m")).cast(f"map<string,{DOCUMENT}>")
    new = F.when(k % 2 == 0, F.create_map(F.lit("rhp"), entry("u2", "nse", None, None))).otherwise(F.create_map(F.lit("rhp"), entry("", None, None, None))).cast(f"map<string,{DOCUMENT}>")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", old.alias("old"), new.alias("new"))
    return rows.select("o_orderkey", store.merge_documents(F.col("old"), F.col("new"))["rhp"].alias("d")).select("o_orderkey", "d.url", "d.source", "d.status", "d.markdown_url")


@query("""WITH e AS (SELECT event_id // 10 AS job_id, event_id, ts, event_type FROM events), j AS (SELECT job_id, arg_max(CASE event_id % 10 WHEN 9 THEN CASE WHEN job_id % 3 = 0 THEN 'failed' ELSE 'completed' END ELSE 'running' END, event_id) FILTER (WHERE event_id % 10 IN (0, 9)) AS status,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at, count(*) FILTER (WHERE event_id % 10 BETWEEN 1 AND 8) AS logs FROM e GROUP BY 1)
SELECT job_id, status, created_at, logs FROM j""")
def q_jobs(spark, sf_dir):
    k = F.col("event_id") % 10
    job = F.floor(F.col("event_id") / 10)
    kind = F.when(k == 0, "running").when(k == 9, F.when(job % 3 == 0, "failed").otherwise("completed")).otherwise("log")
    events = table(spark, sf_dir, "events").select(job.alias("job_id"), F.lit("scrape").alias("type"), F.col("event_id").alias("ord"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), kind.alias("event"), F.col("event_type").alias("msg"))
    jobs = store.job_states(events)
    state = F.when(F.col("status").isNotNull(), F.col("status"))
    return jobs.select("job_id", state.alias("status"), "created_at", F.size("logs").cast("long").alias("logs"))


@query("""WITH gone AS (SELECT user_id AS slug FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 5 = 0) SELECT 'entities' AS kept, count(*) AS n FROM (SELECT DISTINCT user_id AS slug FROM events) ANTI JOIN gone USING (slug)
UNION ALL SELECT 'history', count(*) FROM (SELECT user_id AS slug FROM events) ANTI JOIN gone USING (slug)""")
def q_delete_cascade(spark, sf_dir):
    history = table(spark, sf_dir, "events").select(F.col("user_id").alias("slug"))
    left, points = store.delete_cascade(history.distinct(), history, history.where("slug % 5 = 0").distinct())
    count = lambda frame, name: frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kept"), "n")
    return count(left, "entities").union(count(points, "history"))


@query("SELECT p_partkey, least(p_size % 8 + 1, 5)::BIGINT AS n, 'new' AS last, CASE WHEN p_size % 8 > 4 THEN p_size % 8 - 3 WHEN p_size % 8 > 0 THEN 1 END::BIGINT AS first FROM part")
def q_error_log(spark, sf_dir):
    k = F.col("p_size") % 8
    before = F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda x: x.cast("string")))
    grown = store.append_error(before, F.lit("new"))
    return table(spark, sf_dir, "part").select("p_partkey", grown.alias("e")).select("p_partkey", F.size("e").cast("long").alias("n"), F.element_at("e", -1).alias("last"), F.get("e", F.lit(0)).try_cast("long").alias("first"))


# --- document extraction -----------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN contains(t, 'DRAFT RED HERRING') THEN 'DRHP' WHEN contains(t, 'RED HERRING PROSPECTUS') THEN 'RHP' WHEN contains(t, 'PROSPECTUS') THEN 'PROSPECTUS' WHEN contains(t, 'ADDENDUM') OR contains(t, 'CORRIGENDUM') THEN 'ADDENDUM' END AS doc_type
FROM (SELECT doc_id, upper(CASE doc_id % 5 WHEN 0 THEN 'Draft Red Herring Prospectus ' WHEN 1 THEN 'Red Herring Prospectus ' WHEN 2 THEN 'This prospectus ' WHEN 3 THEN 'Corrigendum ' ELSE '' END || text) AS t FROM documents)""")
def q_classify(spark, sf_dir):
    head = F.element_at(F.array(*[F.lit(x) for x in ("Draft Red Herring Prospectus ", "Red Herring Prospectus ", "This prospectus ", "Corrigendum ", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", extraction.document_type(F.concat(head, "text")).alias("doc_type"))


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t, trim(regexp_replace(lower(text[11:50]), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS q FROM documents)
SELECT doc_id, length(q) >= 8 AND contains(t, CASE WHEN doc_id % 4 = 0 THEN q || 'x@x' ELSE q END) AS verified FROM n""")
def q_evidence(spark, sf_dir):
    quote = F.substring("text", 11, 40)
    quote = F.when(F.col("doc_id") % 4 == 0, F.concat(F.rtrim(F.translate(quote, "\n\t", "  ")), F.lit("x@x"))).otherwise(quote)
    return table(spark, sf_dir, "documents").select("doc_id", extraction.evidence_found(F.col("text"), quote).alias("verified"))


@query("""SELECT l_orderkey, l_linenumber, low < high AND high <= low * 1.25 AS band, high * lot BETWEEN 13000 AND 16000 AS application, face IN (1, 2, 5, 10) AS face
FROM (SELECT l_orderkey, l_linenumber, l_quantity * 10 AS low, l_quantity * 10 + l_linenumber * 20 AS high, l_orderkey % 100 AS lot, l_linenumber AS face FROM lineitem)""")
def q_rules(spark, sf_dir):
    low = F.col("l_quantity") * 10
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", low.alias("low"), (low + F.col("l_linenumber") * 20).alias("high"), (F.col("l_orderkey") % 100).alias("lot"), F.col("l_linenumber").alias("face"))
    return rows.select("l_orderkey", "l_linenumber", extraction.band_rule("low", "high").alias("band"), extraction.application_rule("lot", "high").alias("application"), extraction.face_value_rule("face").alias("face"))


@query("""WITH t AS (SELECT l_partkey % 200 AS ipo, ['DRHP', 'RHP', 'PROSPECTUS', 'ADDENDUM'][l_linenumber % 4 + 1] AS doc_type, l_shipdate AS processed_at, l_orderkey, l_linenumber, l_extendedprice AS value FROM lineitem)
SELECT ipo, arg_max(value, (CASE doc_type WHEN 'ADDENDUM' THEN 4 WHEN 'PROSPECTUS' THEN 3 WHEN 'RHP' THEN 2 ELSE 1 END, processed_at, l_orderkey, l_linenumber)) AS value FROM t GROUP BY 1""")
def q_precedence_merge(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("DRHP", "RHP", "PROSPECTUS", "ADDENDUM")]), F.col("l_linenumber") % 4 + 1)
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("ipo"), kind.alias("doc_type"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("processed_at"), F.col("l_extendedprice").alias("value"))
    return extraction.canonical_value(rows, "ipo")


@query("SELECT event_type AS layer, count(*) AS tried, count(*) FILTER (WHERE value > 50) AS won, round(count(*) FILTER (WHERE value > 50) / count(*), 6) AS win_rate FROM events GROUP BY 1")
def q_layer_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("layer"), (F.col("value") > 50).alias("validated"))
    return extraction.layer_stats(rows)


@query("WITH t AS (SELECT doc_id, sha256(text) AS code, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) SELECT doc_id, code FROM t WHERE n = 1")
def q_exact_content(spark, sf_dir):
    return extraction.distinct_content(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query("""WITH l AS (SELECT user_id AS field, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS layer, value FROM events WHERE value > 20)
SELECT field, arg_min(value, layer) AS value, count(DISTINCT CASE WHEN layer <= 2 THEN value END) > 1 AS disputed FROM l GROUP BY 1""")
def q_extraction_ladder(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").where("value > 20").select(F.col("user_id").alias("field"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("layer"), "value")
    return extraction.first_layer(rows, "field")
