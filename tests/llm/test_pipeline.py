"""The whole pipeline against a plain version of its stages."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from tallymere.llm import pieces
from tests.llm.test_texts import brute_groups, shingles, without_passages

WORDS = {"en": "the and with from house water people never always between under through".split(), "de": "der und nicht straße über wasser häuser niemals zwischen unter durch immer".split()}
ITEM = "what is the name of the longest river that flows through seven different countries"


def sentence(r, lang, n=14):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.choice('klmnrst')}"]) for _ in range(n))


def fixture():
    """Rows (doc_id, text, lang): prose, exact and near copies, shared passages, an item inside a long text, and texts that the first stage rejects."""
    r = random.Random(21)
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append((i, "\n".join(sentence(r, lang) for _ in range(r.randint(2, 6))), lang))
    passage = [sentence(r, "en") for _ in range(3)]
    for i in (60, 61, 62):
        rows.append((i, "\n".join([sentence(r, "en"), *passage, sentence(r, "en")]), "en"))
    rows += [(63, rows[5][1], "en"), (64, rows[6][1], "de")]
    for i in (65, 66):  # one line whose last words differ, so no pair of lines repeats
        rows.append((i, sentence(random.Random(3), "en", 60) + f" ending {i}", "en"))
    rows.append((67, f"{sentence(r, 'en', 30)} {ITEM} {sentence(r, 'en', 30)}", "en"))
    rows += [(70, None, "en"), (71, "", "de"), (72, "1234 5678", None), (73, "привет мир и все люди", None), (74, "\n".join(passage), "en")]
    return rows


def plain(rows, items):
    kept = [(i, t) for i, t, _ in rows if i < 70 or i == 74]
    short = without_passages(kept)
    kept = [(i, short[i][0]) for i, _ in kept if not short[i][2] or shingles(short[i][0])]
    group = {i: c for i, n, c in brute_groups(kept) if n}
    kept = [(i, t) for i, t in kept if i not in group or group[i] == i]
    found = lambda t, item: 100 * len(shingles(t) & shingles(item)) >= 80 * len(shingles(item))
    return {i: t for i, t in kept if not any(shingles(item) and found(t, item) for _, item in items)}


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in fixture()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_equals_a_plain_version(spark, folder):
    expected = plain(fixture(), [(1, ITEM)])
    assert {60, 65} <= set(expected) and {63, 64, 66, 67, 74}.isdisjoint(expected)
    model = pieces.Pieces.load()
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(expected) and all(r["round_trip"] for r in out)
    ids, offsets = model.encode(pa.array([expected[r["doc_id"]] for r in out]))
    assert all(r["ids"] == ids[lo:hi].tolist() and r["n_pieces"] == hi - lo for r, lo, hi in zip(out, offsets, offsets[1:]))


def test_stages_keep_the_columns_and_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and {1, 2, 3, 60} <= {r["doc_id"] for r in out.collect()}
        assert stage(spark, docs.limit(0), folder).count() == 0
    copies = corpus_pipeline.drop_near_duplicates(spark, docs.union(docs.where("doc_id = 1")), folder)
    assert Counter(r["doc_id"] for r in copies.collect())[1] == 1
