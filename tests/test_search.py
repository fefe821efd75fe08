"""Searches through the index against scans."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallymere.operators import buckets, listing, pages, search

SCHEMA = "slug string, company_name string, symbol string, isin string"


@pytest.mark.parametrize(
    "pattern, expected",
    [
        ("foods", [{"foo", "ood", "ods"}]), ("FOOds", [{"foo", "ood", "ods"}]), ("abc|defg", [{"abc"}, {"def", "efg"}]), ("x(abc|de)f", [{"xab", "abc", "bcf"}, {"xde", "def"}]),
        ("abc.*xyz", [{"abc", "xyz"}]), ("^abc$", [{"abc"}]), ("(abc)+d", [{"abc"}]), ("abc?d", None), ("abcd?", [{"abc"}]), ("a.b", None), ("ab|cde", None), ("[abc]def", [{"def"}]), ("ab\\.c", None), ("(?x)abc", None), ("(", None), ("", None),
    ],
)
def test_grams_that_a_pattern_needs(pattern, expected):
    assert search.required_grams(pattern) == expected


def test_a_needed_gram_is_in_every_match():
    r = random.Random(2)
    parts = ["a", "b", "c", "d", ".", "[ab]", "(ab|cd)", "(abc)+", "b?", "c*", "(a|bc|)", "^", "$"]
    for _ in range(3000):
        pattern = "".join(r.choice(parts) for _ in range(r.randint(1, 7)))
        wanted = search.required_grams(pattern)
        for _ in range(5):
            text = "".join(r.choice("abcd") for _ in range(r.randint(0, 9)))
            if wanted and re.search(pattern, text):
                assert any(all(g in text for g in own) for own in wanted), (pattern, text)


def test_searches_equal_scans(spark, tmp_path):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(60)]
    rows = [(f"s{i}", r.choice([None, "", f"{r.choice(words).title()} {r.choice(words)} Ltd."]), r.choice([None, r.choice(words).upper()]), f"INE{i:05}") for i in range(400)]
    entities = spark.createDataFrame(rows, SCHEMA)
    store = buckets.BucketStore(spark, str(tmp_path / "store"), SCHEMA, buckets=8)
    store.replace_all(entities)
    search.write_index(store.entities(), str(tmp_path / "index"), folders=8)
    patterns = [words[0], words[1][:4], f"{words[2]}|{words[3]}", "ltd.$", f"^{words[4]}.*ltd", "ine0007", "ine00(1|2)", "a.c", "", "zzz", "[0-9]+7$", f"({words[5]} )+", "ÄÖÜ"]
    for pattern in patterns:
        want = sorted(x["slug"] for x in listing.matching(entities, search=pattern).collect())
        assert sorted(x["slug"] for x in search.search(store, str(tmp_path / "index"), pattern, folders=8).collect()) == want, pattern
    few = search.candidates(spark, str(tmp_path / "index"), search.required_grams("ine00071"), folders=8)
    assert few.count() == 1


def test_a_gram_of_all_entities_is_written_by_several_tasks(spark, tmp_path):
    """By gram alone, one task sorted all of its rows."""
    entities = spark.range(4000).selectExpr("concat('s', id) slug", "'abc' company_name", "cast(null as string) symbol", "cast(null as string) isin")
    search.write_index(entities, str(tmp_path / "index"), size=1000)
    files = spark.read.parquet(str(tmp_path / "index")).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slug").alias("s")).collect()
    assert sum(f["n"] for f in files) == sum(f["s"] for f in files) == 4000 and len(files) == 4


def test_candidates_are_not_summed_before_their_rows_meet(spark, tmp_path):
    """A sum for each slug in the task that reads a gram of all entities holds as many slugs as there are."""
    entities = spark.range(300).selectExpr("concat('s', id) slug", "if(id % 3 = 0, 'abcd', 'abc xbc') company_name", "if(id % 5 = 0, 'wxyz', null) symbol", "cast(null as string) isin")
    search.write_index(entities, str(tmp_path / "index"))
    out = search.candidates(spark, str(tmp_path / "index"), search.required_grams("abcd|wxyz"), rows=100)
    assert sorted(int(r["slug"][1:]) for r in out.collect()) == [k for k in range(300) if k % 3 == 0 or k % 5 == 0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_pages_by_place_equal_pages_by_offset(spark, small, tmp_path):
    from tallymere.plans.store_queries import orders_as_entities

    entities = orders_as_entities(spark, small).drop("documents", "sources", "gmp", "price_band").limit(700).persist()
    for sort, order in ((None, None), ("name", "asc")):
        path = str(tmp_path / f"{sort}")
        pages.write_pages(entities, path, sort, order, ranges=6)
        wanted = [r["slug"] for r in entities.orderBy(*listing.order_of(sort, order)).collect()]
        for page in (1, 3, 14, 15):
            assert [r["slug"] for r in pages.page_at(spark, path, page, 50).collect()] == wanted[50 * page - 50 : 50 * page]
        deep = pages.page_at(spark, path, 9, 50)
        read = deep.select("slug", F.input_file_name().alias("f")).select("f").distinct().count()
        assert read <= 2 < spark.read.parquet(f"{path}/rows").select("range").distinct().count()
        token, seen = -1, []
        while rows := pages.page_after(spark, path, token, 200).collect():
            seen += [r["slug"] for r in rows]
            token = rows[-1]["place"]
        assert seen == wanted
    entities.unpersist()
