"""Scalar functions on known values, and the similarity against a plain model."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallymere.functions import dates, names, numbers
from tallymere.functions.similarity import jaro_winkler
from tallymere.operators import extraction, store
from tallymere.operators.listing import page_of
from tallymere.sources import html


def of(spark, function, inputs, kind="string"):
    frame = spark.createDataFrame([(x,) for x in inputs], f"x {kind}").coalesce(1)
    out = [r[0] for r in frame.select(function(F.col("x"))).collect()]
    return [tuple(x) if isinstance(x, tuple) else x for x in out]


# Inputs of each function with what it must give.
TEXTS = [
    (names.company_key, {"Apex Logistics Limited": "apex logistics", "Apex Logistics Ltd.": "apex logistics", "  Apex   Logistics  ": "apex logistics", "Apex IPO Details": "apex", "Apex Corp & Co!": "apex", "": "", None: "", "élimited x": "x", "foo bar": "foo bar"}),
    (names.premium_key, {"Apex Corp Ltd.": "apex corp", "Apex IPO": "apex", None: ""}),
    (names.symbol_key, {"RELIANCE-EQ": "RELIANCE", "TATA-BE": "TATA", "INFY.NS": "INFY", "500180.BO": "500180", "": "", None: "", "X-EQ ": "X-EQ"}),
    (names.slug, {"Hexagon Nutrition Limited": "hexagon-nutrition-ipo", "Reliance Industries Ltd.": "reliance-industries-ipo", "Foo & Bar Pvt Ltd": "foo-and-bar-ipo", None: "unknown-ipo", "Limited": "unknown-ipo"}),
    (names.document_class, {"rhphorizon.pdf": "rhp", "abc-drhp.pdf": "drhp", "company-final.pdf": "final", "SUSAN_inprinciple.pdf": "drhp", None: None}),
    (names.bare_url, {" http://a/b// ": "http://a/b", None: ""}),
    (dates.iso_date, {"25-MAY-2026": "2026-05-25", "2026-05-25": "2026-05-25", "05 Jun 2026": "2026-06-05", None: None, "invalid-date-string": None, "2026-02-31": "2026-03-03"}),
    (dates.event_date, {"2026-06-05": "2026-06-05", "09-Jun-2026": "2026-06-09", "21-MAY-2026": "2026-05-21", "not-a-date": None, "32-Jan-2026": None, "": None, None: None, "2026-02-31": "2026-02-31", "2026-06-12T00:00:00": None}),
    (dates.premium_date, {"09-06-2026": "2026-06-09", "garbage": None, None: None}),
    (dates.date_range, {"05th – 09th Jun 2026": ("2026-06-05", "2026-06-09"), "12 Jun 2026": ("2026-06-12", "2026-06-12"), "To be announced": (None, None), "28th May – 02nd Jun 2026": ("2026-06-28", "2026-06-02"), None: (None, None)}),
    (numbers.price_range, {"Rs.326 to Rs.343": (326, 343), "Rs.42 - Rs.45": (42, 45), "343": (343, 343), "": (None, None), "100-": (100, 0), None: (None, None)}),
    (numbers.price_band, {"₹42 – ₹45": (42, 45), "₹110 ₹116": (110, 116), "₹1,053": (1053, 1053), "To be announced": (None, None), "42.50": (42, 50)}),
    (numbers.prefix_number, {"12.5%": 12.5, "-3 x": -3, "x": None, None: None, "1e2z": 100}),
]


@pytest.mark.parametrize(("function", "cases"), TEXTS, ids=[f.__name__ for f, _ in TEXTS])
def test_known_values(spark, function, cases):
    assert of(spark, function, cases) == list(cases.values())


def test_other_known_values(spark):
    # fixed values, as above
    assert of(spark, dates.epoch_date, [1780633800000, 0, None], "long") == ["2026-06-05", None, None]
    assert of(spark, numbers.half_up, [-2.005, 2.375, -0.125, None], "double") == [-2.0, 2.38, -0.12, None]
    assert of(spark, lambda c: names.slug(c, F.lit("NSE123")), ["Acme"]) == ["acme-ipo-nse123"]
    rows = [("2026-06-05", "2026-06-09", "2026-06-12"), ("2026-06-10", "2026-06-12", "2026-06-17"), ("2026-05-01", "2026-05-05", "2026-05-08"), (None, None, None)]
    frame = spark.createDataFrame(rows, "a string, b string, c string").coalesce(1)
    assert [r[0] for r in frame.select(dates.infer_status(F.col("a"), F.col("b"), F.col("c"), "2026-06-07")).collect()] == ["open", "upcoming", "listed", None]
    near = [("2026-01-01", "2026-01-31", True), ("2026-01-01", "2026-02-01", False), ("2026-01-01", None, False), ("x", "2026-01-01", False)]
    frame = spark.createDataFrame(near, "a string, b string, same boolean").coalesce(1)
    assert all(r[0] == r[1] for r in frame.select(dates.within_days(F.col("a"), F.col("b")), "same").collect())
    assert [page_of(*x) for x in ((0, 0), (None, 999), ("2", "-3"), ("x", "y"))] == [(1, 50), (1, 200), (2, 1), (1, 50)]


def plain_jaro_winkler(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    window, used, matched = max(len(a), len(b)) // 2 - 1, [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                matched.append(ch)
                break
    if not matched:
        return 0.0
    moved = sum(x != y for x, y in zip(matched, [ch for ch, u in zip(b, used, strict=True) if u], strict=True))
    m = len(matched)
    jaro = (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def test_similarity_equals_a_plain_model(spark):
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcd ") for _ in range(r.randint(0, 12)))
    pairs = [(word(), word()) for _ in range(1500)] + [("Apex Logistics", "Tata Motors"), ("Apex Logistics", "Apex Logistix"), ("Apex Logistics", "Apex Diagnostics"), ("", "Apex"), (None, "Apex"), ("Apex", "Apex")]
    frame = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    got = [r[0] for r in frame.select(jaro_winkler(F.col("a"), F.col("b"))).collect()]
    assert all(abs(x - plain_jaro_winkler(a, b)) < 1e-12 and 0 <= x <= 1 for x, (a, b) in zip(got, pairs, strict=True))
    assert got[-6] < 0.7 and got[-5] >= 0.9 and got[-4] >= 0.9 and got[-3:] == [0.0, 0.0, 1.0]


LIST_PAGE = """<table><tr><th>Name</th></tr>
<tr><td class="ipo-logo"><a href="/ipo/12/apex"><img src="x"></a></td><td class="name"><a href="/ipo/12/apex"><span class="ipo-symbol">APEX <span class="ipo-type">SME</span></span><span class="ipo-name">Apex Logistics</span></a></td>
<td class="date">05th – 09th Jun 2026<span class="hidden">20260605</span></td><td class="date">12 Jun 2026</td><td class="text-right">₹42 – ₹45</td><td class="text-right">9</td></tr>
<tr><td class="name"><a href="/ipo/12/apex/">again</a></td></tr><tr><td class="name"><a href="/other/1/">no</a></td></tr></table>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, LIST_PAGE), (2, None), (3, "")], "page_id long, html string")
    rows = html.extract_rows(pages).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "APEX", "SME", True, "Apex Logistics", "/ipo/12/apex/", "05th – 09th Jun 2026", "12 Jun 2026", "₹42 – ₹45")]
    detail = '<a href="a.pdf">Allotment</a><a href="x.html">Prospectus</a><a href="b.pdf?x">Red Herring <b>Prospectus</b></a><a href="c.pdf">prospectus</a>'
    out = html.extract_prospectus(spark.createDataFrame([(1, detail), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert [r["prospectus_url"] for r in out] == ["b.pdf?x", None]


def test_errors_keep_the_last_five(spark):
    frame = spark.createDataFrame([([],), (["1"],), (list("12345"),), (None,)], "e array<string>").coalesce(1)
    assert [r[0] for r in frame.select(store.append_error(F.col("e"), F.lit("x"))).collect()] == [["x"], ["1", "x"], list("2345x"), ["x"]]


def test_extraction_helpers(spark):
    assert of(spark, extraction.document_type, ["Draft Red Herring Prospectus", "red herring prospectus", "the Prospectus", "Corrigendum", "x", None]) == ["DRHP", "RHP", "PROSPECTUS", "ADDENDUM", None, None]
    assert of(spark, lambda c: extraction.heading_section(c)[0], ["Structure Capital", "THE OBJECTS OF OFFER", "something else"]) == ["capital_structure", "objects", None]
    assert of(spark, extraction.contents_lines, ["Capital Structure ...... 74\nno page\nObjects of the Offer....102"])[0] == [("Capital Structure", 74), ("Objects of the Offer", 102)]
    assert of(spark, lambda c: extraction.evidence_found(F.lit("The  Price\nis Rs 100"), c), ["price IS rs", "rs 100", None]) == [True, False, False]


def test_small_rows_with_much_work_are_dealt(spark, small):
    from tallymere.plans.catalog import dealt

    assert dealt(spark.range(9_000), "id").rdd.getNumPartitions() == 5
    assert dealt(spark.range(0), "id").count() == 0
