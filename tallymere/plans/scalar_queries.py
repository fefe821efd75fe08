"""Queries of the scalar functions over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, names, numbers
from ..functions.similarity import jaro_winkler
from ..operators.match import SAME, similar_names
from ..sources.html import link_targets
from .catalog import TODAY, query, table
from .feeds import BASE, base
from .scratch import Scratch

# Regular expressions of the SQL side: word boundaries are ASCII there.
SPACE_SQL = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE_SQL}]+|[{SPACE_SQL}]+$', '', 'g')"


def key_sql(x: str, words: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower({x}), '\\b({words})\\b', '', 'g'), '[^a-z0-9{SPACE_SQL}]', '', 'g')"
    return "coalesce(" + trim_sql(f"regexp_replace({bare}, '[{SPACE_SQL}]+', ' ', 'g')") + ", '')"


COMPANY_SQL = key_sql("name", names.COMPANY_WORDS)


@query(f"WITH {BASE} SELECT i, {COMPANY_SQL} AS company FROM base")
def q_company_norm(spark, sf_dir):
    return base(spark, sf_dir).select("i", names.company_key(F.col("name")).alias("company"))


@query(f"WITH {BASE} SELECT i, {key_sql('name', names.PREMIUM_WORDS)} AS company FROM base")
def q_gmp_name_norm(spark, sf_dir):
    return base(spark, sf_dir).select("i", names.premium_key(F.col("name")).alias("company"))


SYMBOL_SQL = "coalesce(trim(regexp_replace(regexp_replace(upper(symbol), '-(BE|EQ)$', ''), '\\.(NS|BO)$', '')), '')"


@query(f"WITH {BASE} SELECT i, {SYMBOL_SQL} AS symbol_key FROM base")
def q_symbol_norm(spark, sf_dir):
    return base(spark, sf_dir).select("i", names.symbol_key(F.col("symbol")).alias("symbol_key"))


def slug_sql(x: str) -> str:
    inner = f"regexp_replace(replace(lower({x}), '&', ' and '), '\\b({names.SLUG_WORDS})\\b', ' ', 'g')"
    inner = f"regexp_replace(trim(regexp_replace({inner}, '[^a-z0-9]+', ' ', 'g')), ' +', '-', 'g')"
    return f"CASE WHEN {inner} = '' THEN 'unknown-ipo' ELSE {inner} || '-ipo' END"


@query(f"WITH {BASE} SELECT i, {slug_sql('name')} AS slug, {slug_sql('name')} || '-' || regexp_replace(lower(symbol), '[^a-z0-9]+', '', 'g') AS suffixed FROM base WHERE symbol IS NOT NULL")
def q_slugify(spark, sf_dir):
    rows = base(spark, sf_dir).where("symbol is not null")
    return rows.select("i", names.slug(F.col("name")).alias("slug"), names.slug(F.col("name"), F.col("symbol")).alias("suffixed"))


DATE_TEXT = "CASE l_orderkey % 5 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%d-%b-%Y') WHEN 2 THEN strftime(l_shipdate, '%d %B %Y') WHEN 3 THEN upper(strftime(l_shipdate, '%d-%b-%Y')) ELSE 'soon' END"


def _date_texts(spark, sf_dir):
    d = F.col("l_shipdate")
    form = F.element_at(F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd-MMM-yyyy"), F.date_format(d, "dd MMMM yyyy"), F.upper(F.date_format(d, "dd-MMM-yyyy")), F.lit("soon")), (F.col("l_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", form.alias("s"))


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, {DATE_TEXT} AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, strftime(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%d-%b-%Y'), try_strptime(s, '%d %B %Y')), '%Y-%m-%d') AS iso FROM t""")
def q_date_parse(spark, sf_dir):
    return _date_texts(spark, sf_dir).select("l_orderkey", "l_linenumber", dates.iso_date(F.col("s")).alias("iso"))


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, {DATE_TEXT} AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, strftime(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%d-%b-%Y')), '%Y-%m-%d') AS iso FROM t""")
def q_timeline_date(spark, sf_dir):
    return _date_texts(spark, sf_dir).select("l_orderkey", "l_linenumber", dates.event_date(F.col("s")).alias("iso"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def q_ig_date(spark, sf_dir):
    s = F.date_format("o_orderdate", "dd-MM-yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.premium_date(s).alias("iso"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def q_epoch_date(spark, sf_dir):
    ms = F.when(F.col("o_orderkey") % 7 == 0, F.lit(0).cast("long")).otherwise(F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.epoch_date(ms).alias("iso"))


PRICES = "SELECT l_orderkey, l_linenumber, l_quantity::INTEGER AS q, (l_quantity + 1 + l_linenumber)::INTEGER AS r FROM lineitem"


def _prices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("q"), (F.col("l_quantity") + 1 + F.col("l_linenumber")).cast("int").cast("string").alias("r"))


@query(f"""WITH t AS ({PRICES}) SELECT l_orderkey, l_linenumber,
  CASE l_orderkey % 4 WHEN 3 THEN NULL ELSE q END::DOUBLE AS minimum, CASE l_orderkey % 4 WHEN 0 THEN r WHEN 1 THEN 0 WHEN 2 THEN q END::DOUBLE AS maximum FROM t""")
def q_price_range(spark, sf_dir):
    rows = _prices(spark, sf_dir)
    s = F.element_at(F.array(F.concat(F.lit("Rs."), "q", F.lit(" to Rs."), "r"), F.concat("q", F.lit("-")), F.concat(F.lit("Rs "), "q"), F.lit("to be said")), (F.col("l_orderkey") % 4 + 1).cast("int"))
    band = numbers.price_range(s)
    return rows.select("l_orderkey", "l_linenumber", band["minimum"].alias("minimum"), band["maximum"].alias("maximum"))


@query(f"""WITH t AS ({PRICES}) SELECT l_orderkey, l_linenumber,
  CASE l_orderkey % 4 WHEN 3 THEN NULL ELSE q END::DOUBLE AS minimum, CASE l_orderkey % 4 WHEN 0 THEN r WHEN 1 THEN 50 WHEN 2 THEN q END::DOUBLE AS maximum FROM t""")
def q_price_band(spark, sf_dir):
    rows = _prices(spark, sf_dir)
    s = F.element_at(F.array(F.concat(F.lit("₹"), "q", F.lit(" – ₹"), "r"), F.concat(F.lit("₹"), "q", F.lit(".50")), F.concat(F.lit("₹"), "q"), F.lit("To be announced")), (F.col("l_orderkey") % 4 + 1).cast("int"))
    band = numbers.price_band(s)
    return rows.select("l_orderkey", "l_linenumber", band["minimum"].alias("minimum"), band["maximum"].alias("maximum"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start_date,
  CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-') || '28' END AS end_date FROM orders""")
def q_date_range(spark, sf_dir):
    d = F.col("o_orderdate")
    s = F.when(F.col("o_orderkey") % 9 == 0, "To be announced").otherwise(F.concat(F.date_format(d, "dd"), F.lit("th – 28th "), F.date_format(d, "MMM yyyy")))
    both = table(spark, sf_dir, "orders").select("o_orderkey", dates.date_range(s).alias("r"))
    return both.select("o_orderkey", F.col("r.start").alias("start_date"), F.col("r.end").alias("end_date"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 3 THEN 0 WHEN 2 THEN 0 WHEN 1 THEN -(q + 0.5) ELSE q + 0.5 END AS or_zero, CASE l_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN NULL WHEN 1 THEN -(q + 0.5) ELSE q + 0.5 END AS or_null FROM t""")
def q_parse_float(spark, sf_dir):
    q = (F.col("l_quantity") + 0.5).cast("string")
    s = F.element_at(F.array(F.concat(q, F.lit("%")), F.concat(F.lit(" -"), q, F.lit(" (est)")), F.lit("0.0%"), F.lit("--")), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.prefix_or_zero(s).alias("or_zero"), numbers.prefix_or_null(s).alias("or_null"))


@query(f"""SELECT o_orderkey, CASE WHEN strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') < '{TODAY.replace("2024", "1996")}' THEN 'listed' WHEN strftime(o_orderdate + INTERVAL 4 DAY, '%Y-%m-%d') < '{TODAY.replace("2024", "1996")}' THEN 'closed'
  WHEN strftime(o_orderdate, '%Y-%m-%d') > '{TODAY.replace("2024", "1996")}' THEN 'upcoming' ELSE 'open' END AS status FROM orders""")
def q_infer_status(spark, sf_dir):
    day = lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.infer_status(day(0), day(4), day(10), TODAY.replace("2024", "1996")).alias("status"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'listed' WHEN 1 THEN 'open' WHEN 2 THEN 'upcoming' WHEN 3 THEN 'closed' WHEN 4 THEN 'bucket' ELSE 'listed' END AS status FROM orders""")
def q_map_status(spark, sf_dir):
    from ..sources.mappers import groww_status

    k = F.col("o_orderkey") % 6
    said = F.element_at(F.array(*[F.lit(x) for x in ("LISTED", "ACTIVE", "PRE_APPLY", "Closed", "else", "OPEN")]), (k + 1).cast("int"))
    out = groww_status(F.lit("bucket"), said, F.when(k == 5, F.lit(10.0)), F.lit(None).cast("array<string>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", out.alias("status"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 4 THEN NULL WHEN lower(url) LIKE '%drhp%' OR lower(url) LIKE '%draft%' OR page_id % 5 = 0 THEN 'drhp' WHEN page_id % 5 = 1 THEN 'rhp' WHEN page_id % 5 = 2 THEN 'final' ELSE 'drhp' END AS kind FROM pages""")
def q_doc_class(spark, sf_dir):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("-DRHP.pdf", "/Red-Herring.pdf", "-final.pdf", ".pdf", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    url = F.when(F.col("page_id") % 5 == 4, None).otherwise(F.concat("url", tail))
    return table(spark, sf_dir, "pages").select("page_id", names.document_class(url).alias("kind"))


@query("SELECT page_id, regexp_replace(trim(url), '/+$', '') AS url FROM pages")
def q_norm_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.bare_url(F.concat(F.lit(" "), "url", F.lit("//"))).alias("url"))


@query(r"""SELECT page_id, t.i::BIGINT AS n, t.link FROM pages, LATERAL (SELECT unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS link, generate_subscripts(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1), 1) AS i) t""")
def q_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(link_targets(F.col("html"))).alias("n", "link")).select("page_id", (F.col("n") + 1).cast("long").alias("n"), "link")


# --- similarity --------------------------------------------------------------------------------------------------

JW = """
jw_s AS (SELECT id, a, b, greatest(length(a), length(b)) // 2 - 1 AS w FROM p WHERE a <> '' AND b <> '' AND a <> b),
jw_f(id, a, b, w, i, r, m) AS (
  SELECT id, a, b, w, 0::BIGINT, b, '' FROM jw_s
  UNION ALL
  SELECT id, a, b, w, i + 1, CASE WHEN q > 0 THEN substr(r, 1, lo + q - 2) || chr(1) || substr(r, lo + q) ELSE r END, CASE WHEN q > 0 THEN m || substr(a, i + 1, 1) ELSE m END
  FROM (SELECT *, CASE WHEN hi < lo THEN 0 ELSE instr(substr(r, lo, hi - lo + 1), substr(a, i + 1, 1)) END AS q
        FROM (SELECT *, greatest(1, i + 1 - w) AS lo, least(length(b), i + 1 + w) AS hi FROM jw_f WHERE i < length(a)))),
jw_e AS (SELECT *, list_filter(range(1, length(b) + 1), lambda j: substr(r, j, 1) = chr(1)) AS js FROM jw_f WHERE i = length(a)),
jw_g AS (SELECT id, a, b, length(m) AS mm, len(list_filter(range(1, length(m) + 1), lambda k: substr(m, k, 1) <> substr(b, js[k], 1))) AS t,
         len(list_filter(range(1, least(4, length(a), length(b)) + 1), lambda q: substr(a, 1, q) = substr(b, 1, q))) AS pf FROM jw_e),
jw_h AS (SELECT id, mm, pf, CASE WHEN mm = 0 THEN 0.0::DOUBLE ELSE (mm::DOUBLE / length(a) + mm::DOUBLE / length(b) + (mm - t::DOUBLE / 2) / mm) / 3 END AS j FROM jw_g),
jw AS (SELECT p.id, p.a, p.b, CASE WHEN p.a = '' OR p.b = '' THEN 0.0::DOUBLE WHEN p.a = p.b THEN 1.0::DOUBLE WHEN mm = 0 THEN 0.0::DOUBLE ELSE j + pf * 0.1::DOUBLE * (1 - j) END AS score
       FROM p LEFT JOIN jw_h USING (id))"""


@query(f"""WITH RECURSIVE {BASE}, k AS (SELECT i, {COMPANY_SQL} AS a FROM base), p AS (SELECT x.i AS id, x.a, coalesce(y.a, '') AS b FROM k x LEFT JOIN k y ON y.i = x.i + 1), {JW}
SELECT id, round(score, 9) AS score FROM jw""")
def q_jaro_winkler(spark, sf_dir):
    k = base(spark, sf_dir).select("i", names.company_key(F.col("name")).alias("a"))
    met = k.join(k.select((F.col("i") - 1).alias("i"), F.col("a").alias("b")), "i", "left")
    return met.select(F.col("i").alias("id"), F.round(jaro_winkler(F.col("a"), F.col("b")), 9).alias("score"))


PAIRS = f"""{BASE}, k AS (SELECT DISTINCT {COMPANY_SQL} AS a FROM base WHERE {COMPANY_SQL} <> ''),
p AS (SELECT row_number() OVER () AS id, x.a, y.a AS b FROM k x JOIN k y ON x.a < y.a AND (least(length(x.a), length(y.a))::DOUBLE / greatest(length(x.a), length(y.a)) + 2) / 3 * 0.6 + 0.4 >= 0.85), {JW}"""


@query(f"WITH RECURSIVE {PAIRS} SELECT a AS x, b AS y, round(score, 9) AS score FROM jw WHERE score >= 0.9")
def q_fuzzy_pairs(spark, sf_dir):
    k = base(spark, sf_dir).select(names.company_key(F.col("name")).alias("name")).where("name <> ''").distinct()
    pairs = similar_names(k, Scratch(spark, "fuzzy-pairs"), SAME, rising=True)
    return pairs.select("x", "y", F.round("score", 9).alias("score"))


@query(f"WITH RECURSIVE {PAIRS} SELECT a AS x, b AS y, round(score, 9) AS score FROM jw WHERE score >= 0.85 AND score < 0.9")
def q_borderline_pairs(spark, sf_dir):
    k = base(spark, sf_dir).select(names.company_key(F.col("name")).alias("name")).where("name <> ''").distinct()
    pairs = similar_names(k, Scratch(spark, "borderline-pairs"), rising=True)
    return pairs.where("score < 0.9").select("x", "y", F.round("score", 9).alias("score"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(abs(date_diff('day', l_shipdate::DATE, o_orderdate::DATE)) <= 30, false) AS close FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q_date_guard(spark, sf_dir):
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    text = lambda c: F.date_format(c, "dd-MMM-yyyy")
    return met.select("l_orderkey", "l_linenumber", dates.within_days(text("l_shipdate"), text("o_orderdate")).alias("close"))
