"""Samples stay bounded and never empty, whatever repeats and however many rows there are."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from tallymere.llm import language, pii, sampling, url_filter


def test_cuts_are_exact_beyond_a_millionth():
    for n in (10**8, 10**11, 10**15):
        for want in (1, 200, 20_000):
            expected = n * sampling.cut_of(want, n) / sampling.SPAN
            assert abs(expected - (2 * want + 64)) < 1
    assert sampling.cut_of(10, 50) == sampling.SPAN - 1


def test_a_text_on_half_of_the_rows_counts_once(spark):
    i = F.col("id")
    rows = spark.range(40_000).select(F.when(i % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), i.cast("string"))).alias("text"), F.when(i % 1000 == 1, "rare").when(i % 3 == 0, F.lit(None)).otherwise("common").alias("label"))
    for equal in (True, False):
        out = sampling.distinct_sample(rows, "text", 500, "label", equal).collect()
        found = Counter(r["label"] for r in out)
        assert 250 < len(out) <= 510 and set(found) == {"rare", "common", None} and max(Counter((r["text"], r["label"]) for r in out).values()) == 1
    assert found["rare"] >= 5  # by its share it would have one
    assert sampling.distinct_sample(rows, "text", 500).count() == 500
    assert sampling.distinct_sample(rows.where("text = 'hot'"), "text", 5).count() == 1
    assert sampling.distinct_sample(rows.limit(0), "text", 5, "label").count() == 0
    again = sampling.distinct_sample(rows.repartition(7), "text", 500).collect()
    assert set(again) == set(sampling.distinct_sample(rows, "text", 500).collect())


def test_all_languages_are_learnt_from_a_small_sample(spark):
    i = F.col("id")
    rows = spark.range(5000).select(F.concat(F.lit("word "), i.cast("string")).alias("text"), F.concat(F.lit("l"), F.when(i < 10, i).otherwise(i % 3 + 20).cast("string")).alias("lang"))
    assert len(language.learn(rows, sample_rows=26).languages) == 13
    same = spark.range(5000).select(F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    assert language.learn(same, sample_rows=10).languages == ["en"]


def test_many_languages_in_small_blocks(spark):
    n = 120
    texts = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=9)) for k in range(n)]
    rows = spark.createDataFrame([(" ".join([t] * 30), f"l{k}") for k, t in enumerate(texts)], "text string, lang string")
    out = language.identify(rows, language.learn(rows)).collect()
    assert len(out) == n and sum(r["lang_pred"] == r["row"]["lang"] for r in out) > 0.9 * n


def test_few_urls_repeated_often(spark):
    urls = spark.range(4000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, "http://a.net/x").otherwise("http://b.org/fr/y").alias("url"))
    out = url_filter.judge(urls, url_filter.RULES, sample_rows=100)
    assert {(r["rule"], r["verdict"]) for r in out.select("rule", "verdict").distinct().collect()} == {("net/", "block"), ("org/fr/", "allow")}


def test_field_is_learnt_from_repeated_rows(spark):
    docs = spark.range(3000).select(F.lit("call +1 234 567 8900 or mail a.b@c.org").alias("text"))
    weights = pii.learn(docs, sample_rows=10)
    assert abs(weights.shapes).max() > 0
