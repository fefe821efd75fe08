"""Whole scans of feeds, and what they are made of, against written-out results."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallymere.operators.scrape import run_landed
from tallymere.schemas import RANK
from tallymere.sources import feeds, html, mappers


def landing(spark, rows):
    return spark.createDataFrame([(o, b, json.dumps(p)) for o, b, p in rows], "ord long, bucket string, payload string")


def details(spark, rows):
    return spark.createDataFrame([(i, json.dumps(p)) for i, p in rows], "id string, payload string")


def shown(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.orderBy("ord").collect()]


def test_later_lists_replace_items_at_the_first_place(spark):
    lists = landing(spark, [
        (1, "current", {"symbol": "A", "companyName": "Alpha"}), (2, "current", {"companyName": "no symbol"}), (3, "upcoming", {"symbol": "B", "companyName": "Beta"}),
        (4, "past", {"symbol": "A", "companyName": "Alpha past"}), (5, "past", {"companyName": "Gamma"}), (6, "past", {"companyName": "Gamma", "status": "x"}), (7, "past", {"symbol": "D", "isin": "I1"}),
    ])
    found = details(spark, [("A", {"metaInfo": {"isin": "I9", "listingDate": "01-Jan-2024"}}), ("D", {"metaInfo": {"isin": "other"}})])
    got = shown(feeds.nse(lists, found).withColumn("o", F.col("ord") - RANK), "o", "symbol", "company_name", "status", "isin", "listing_date")
    assert got == [(1, "A", "Alpha past", "closed", "I9", "01-Jan-2024"), (3, "B", "Beta", "upcoming", None, None), (5, None, "Gamma", "x", None, None), (7, "D", None, "closed", "I1", None)]


def test_first_list_wins_and_details_are_limited(spark):
    lists = landing(spark, [(1, "open", {"searchId": "a"}), (2, "upcoming", {"searchId": "a", "isin": "I"}), (3, "closed", {"isin": "J"}), (4, "closed", {}), (5, "closed", {"searchId": "c"}), (6, "other", {"searchId": "d"})])
    found = details(spark, [("a", {"companyShortName": "A", "documentUrl": "u"}), ("c", {"companyShortName": "C", "status": "LISTED"})])
    columns = ("company_name", "isin", "status")
    assert shown(feeds.groww(lists, found), *columns) == [("A", None, "open"), (None, "J", "closed")]
    assert shown(feeds.groww(lists, found, include_listed=True), *columns) == [("A", None, "open"), (None, "J", "closed"), ("C", None, "listed")]
    assert shown(feeds.groww(lists, found, max_details=1), *columns) == [("A", None, "open"), (None, "J", "closed"), (None, None, "closed")]
    assert [json.loads(r["raw_sources"]["groww"]) for r in feeds.groww(lists, found, docs_only=True).orderBy("ord").collect()] == [{"searchId": "a", "documentUrl": "u"}, {"searchId": None, "documentUrl": None}]
    assert feeds.groww(lists, None).count() == 3


def test_answers_are_unpacked(spark):
    rows = [(1, "open", '{"ipoList":[{"a":1},{"a":{"b":[2]}}],"data":[]}'), (2, "open", '{"data":[{"a":3}]}'), (3, "closed", '{"results":{"a":4}}'), (4, "closed", None), (5, "closed", '{"data":[]}')]
    got = feeds.unpack(spark.createDataFrame(rows, "ord long, bucket string, payload string")).orderBy("ord").collect()
    assert [(r["ord"], r["bucket"], json.loads(r["payload"])) for r in got] == [(0, "open", {"a": 1}), (1, "open", {"a": {"b": [2]}}), (2, "open", {"a": 3})]


def test_each_live_bucket_gives_its_items(spark):
    lists = landing(spark, [(1, "upcoming", {"id": "1", "name": "One IPO"}), (2, "open", {"id": "1", "name": "One"}), (3, "listed", {"id": "3"}), (4, "closed", {"id": "4", "name": "Four"})])
    assert shown(feeds.upstox(lists, details(spark, [("4", {"id": "4", "name": "Detail"})])), "ord", "company_name") == [(1, "One"), (2, "One"), (4, "Detail")]


def test_members_of_json_objects(spark):
    rows = spark.createDataFrame([("{}", "1"), ('{"a": "$1"} ', '{"b":"\\\\$x"}'), ('{"a":1}', None)], "p string, v string")
    got = [r[0] for r in rows.select(feeds.with_member(F.col("p"), "d", F.col("v"))).collect()]
    assert json.loads(got[0]) == {"d": 1} and json.loads(got[1]) == {"a": "$1", "d": {"b": "\\$x"}} and got[2] == '{"a":1}'


def test_pages_nested_deeper_than_calls():
    page = "<table><tr>" + "<div>" * 10_000 + '<td class="name"><a href="/ipo/1/x">n</a></td>' + "</div>" * 10_000 + '</tr></table><a href="/p.pdf">' + "<i>" * 10_000 + "Prospectus"
    assert html.parse(page).text().endswith("Prospectus") and html.prospectus_link(page) == "/p.pdf"
    assert len(html.list_rows(page)) == 1


def cell(kind, inside):
    return f'<td class="{kind}">{inside}'


def row(i, end):
    return "<tr>" + end.join([cell("name", f'<a href="/ipo/{i}/x"><span class="ipo-symbol">S{i}</span><b class="ipo-name">N{i}</b></a>'), cell("date", f"d{i}"), cell("date", f"l{i}"), cell("text-right", f"p{i}"), ""])


def test_rows_whose_end_tags_are_left_out():
    expected = [(f"S{i}", f"N{i}", f"d{i}", f"l{i}", f"p{i}") for i in (1, 2)]
    shown = lambda page: [(r["symbol"], r["company_name"], r["bidding_range"], r["listing_date_text"], r["price_text"]) for r in html.list_rows(page)]
    for page in (
        f"<table>{row(1, '</td>')}</tr>{row(2, '</td>')}</tr></table>", f"<table>{row(1, '')}{row(2, '')}</table>", f"<table><tbody>{row(1, '')}<tbody>{row(2, '')}",
        f"<table>{row(1, '<p>')}{row(2, '</div></span>')}</table>", f"<div><table><thead><tr><th>h{row(1, '')}</thead>{row(2, '<i>')}</table></div>",
        "<table>" + row(1, "").replace('<td class="text-right">', '<td><table><tr><td>inner<tr><td>more</table><td class="text-right">') + row(2, "") + "</table>",
    ):
        assert shown(page) == expected, page
    assert shown(row(1, "</td>") + "</tr>") == []  # rows outside of a table are none
    # what stands between cells goes before the table, and ends no row
    assert shown(f"<table>{row(1, '')}<tr><div>x{row(2, '</td>x<br>')}</table>") == expected


def test_trees_as_browsers_build_them():
    def drawn(node):
        return "".join(x if isinstance(x, str) else f"<{x.tag}>{drawn(x)}</{x.tag}>" for x in node.children)

    for page, tree in (
        ("<p>a<p>b<div>c", "<p>a</p><p>b</p><div>c</div>"), ("<ul><li>a<ul><li>b</ul><li>c</ul>d", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>d"), ("<a>x<a>y</a>", "<a>x</a><a>y</a>"),
        ("<div><table><tr><td></div>a</td></tr></table>b</div>", "<div><table><tr><td>a</td></tr></table>b</div>"), ("<table>x<tr>y<td>z</table>", "xy<table><tr><td>z</td></tr></table>"), ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<table><td>a<td>b</table>", "<table><tr><td>a</td><td>b</td></tr></table>"), ("</p></table>a<td>b", "ab"),
    ):
        assert drawn(html.parse(page)) == tree, page


def test_pages_that_come_by_clocks(spark):
    page = "<table>" + row(1, "") + row(2, "") + "</table>"
    pages = spark.createDataFrame([(1_700_000_000_000_000_000, page), (1_600_000_000_000_000_000, page.replace("/ipo/", "/ipo/9"))], "ord long, html string")
    got = feeds.zerodha(pages, None, "2024-01-01").orderBy("ord").collect()
    assert [(r["ord"] - 3 * RANK, r["symbol"], json.loads(r["raw_sources"]["zerodha"])["detailUrl"][-8:]) for r in got] == [(0, "S1", "po/91/x/"), (1, "S2", "po/92/x/"), (2, "S1", "/ipo/1/x/"[-8:]), (3, "S2", "/ipo/2/x/"[-8:])]


def test_numbers_follow_the_order(spark):
    from tallymere.sources.scans import numbered

    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 as a", "id as b").repartition(7)
    assert [r["n"] for r in numbered(rows.withColumn("c", F.col("a")), "a", name="n").orderBy("c").collect()] == list(range(1000))
    assert numbered(rows.limit(0), "a").count() == 0


def test_orders_as_large_as_clocks_keep_sources_apart(spark):
    rows = spark.createDataFrame([(1_700_000_000_000_000, "{}")], "ord long, payload string")
    both = mappers.standard_records({"upstox": rows, "nse": rows.withColumn("ord", F.lit(0).cast("long"))}, "2024-01-01")
    assert [r["src"] for r in both.orderBy("ord").collect()] == ["upstox", "nse"]


def test_a_run_from_landed_lists(spark):
    nse = landing(spark, [(1, "current", {"symbol": "AAA", "companyName": "Alpha Foods Limited", "status": "Active", "ipoStartDate": "05-Jun-2024"})])
    upstox = landing(spark, [(1, "open", {"id": "1", "symbol": "AAA", "name": "Alpha Foods IPO", "isin": "INE1"}), (2, "listed", {"id": "2", "symbol": "BBB"})])
    run = run_landed({"nse": (nse, details(spark, [("x", {})])), "upstox": (upstox, details(spark, [("x", {})]))}, None, "2024-06-06T00:00:00.000Z", "2024-06-06", sources=["upstox", "nse", "nowhere"])
    assert {(r["source"], r["records"]) for r in run.counts.collect()} == {("upstox", 1), ("nse", 1), ("nowhere", 0)}
    assert [tuple(r) for r in run.errors.collect()] == [("nowhere", "unknown source")] and tuple(run.merged.first())[:2] == (2, 1)
    assert [r["slug"] for r in run.state.collect()] == ["alpha-foods-ipo"]


def test_an_empty_name_stays_as_it_was_delivered(spark):
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate([{"companyName": ""}, {"companyName": "N"}, {}])], "ord long, payload string")
    assert [r["company_name"] for r in mappers.zerodha(rows, "2024-01-01").orderBy("ord").collect()] == ["", "N", None]


def test_empty_names_and_long_texts_of_all_feeds(spark):
    long = "y" * 20_000_001
    row = lambda *payloads: spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "ord long, payload string")
    given = {
        "upstox": row({"name": ""}, {"name": " A IPO"}, {}), "nse": row({"companyName": "", "company": "C"}, {"companyName": ""}, {}),
        "groww": row({"list": {"companyName": ""}, "detail": {"companyName": "D"}}, {"list": {"companyName": ""}}, {"list": {}}), "zerodha": row({"symbol": "S", "companyName": long}),
    }
    got = [(r["src"], r["company_name"]) for r in mappers.standard_records(given, "2024-01-01").orderBy("ord").collect()]
    assert got[:9] == [("upstox", ""), ("upstox", " A"), ("upstox", None), ("nse", "C"), ("nse", ""), ("nse", None), ("groww", "D"), ("groww", ""), ("groww", None)]
    assert got[9][1] == long


def test_made_records_of_large_numbers(spark, tmp_path):
    from tallymere.plans import feeds as made

    spark.createDataFrame([((1 << 58) + k, "a b c d", 5) for k in (0, 4, 8, 12)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["name"] for r in made.base(spark, str(tmp_path)).orderBy("i").collect()] == ["a b c Limited", "a b c Ltd.", "a b c IPO", "a b c"]


def empty_documents(spark, folder):
    spark.createDataFrame([(16 * 300 + k, "", 0) for k in (12, 13, 14, 15)], "doc_id long, text string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_records_that_are_not_listed_show_empty_names(spark, tmp_path):
    from tallymere.plans.record_queries import q_without_listed

    got = q_without_listed(spark, empty_documents(spark, tmp_path)).orderBy("ord").collect()
    assert [(r["src"], r["status"], r["company_name"]) for r in got] == [("nse", "forthcoming", ""), ("zerodha", "upcoming", "")]


def test_entities_of_the_query_show_empty_names(spark, tmp_path):
    from tallymere.plans.record_queries import q_ipo_doc

    assert [tuple(r) for r in q_ipo_doc(spark, empty_documents(spark, tmp_path)).select("company_name", "display_name").collect()] == [("", " IPO")] * 4
