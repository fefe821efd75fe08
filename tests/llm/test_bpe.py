"""Byte-level BPE against the library that defines it."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymere.llm import bpe

LETTERS = ["'", " ", "  ", "\n", "\t", "s", "t", "re", "ve", "m", "ll", "d", "a", "R", "1", "23", "!", "..", "é", "漢", "<|endoftext|>", "<|endo", "😀", "aaaa", "\x1c", "\r", "'s", "'ll"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.ByteBPE.load()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def agree(vocabulary, library, texts, special=True):
    library.encode_special_tokens = not special
    ids, offsets = vocabulary.encode(pa.array(texts, pa.string()), special=special)
    wanted = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == wanted
    assert vocabulary.decode(ids, offsets) == library.decode_batch(wanted, skip_special_tokens=False)
    library.encode_special_tokens = False


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("size", [3, 8, 40])
def test_any_texts(vocabulary, library, size, special):
    r = random.Random(size)
    agree(vocabulary, library, ["".join(r.choice(LETTERS) for _ in range(r.randint(0, size))) for _ in range(3000)], special)


def test_every_character(vocabulary, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    agree(vocabulary, library, ["x" + "".join(every[i : i + 97]) + " " + every[i] for i in range(0, len(every), 97)])


def test_long_words_and_runs(vocabulary, library):
    agree(vocabulary, library, ["a" * 100_000, "ab" * 50_001, " " * 1000, "\n" * 777 + "x", "", None, "<|endoftext|>" * 5, "x <|endoftext|> y"])


def test_words_are_forgotten_without_effect(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    known = bpe.Known(vocabulary)
    for text in ("one two three four five", "two six", "<|endoftext|> seven one"):
        ids, _ = vocabulary.encode(pa.array([text]), known)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_that_are_no_text_decode_as_in_the_library(spark, vocabulary, library):
    r = random.Random(4)
    lists = [[r.randrange(50257) for _ in range(r.randint(0, 30))] for _ in range(200)]
    frame = spark.createDataFrame([*enumerate(lists), (900, None)], "n long, ids array<int>")
    got = {x["row"]["n"]: x["decoded"] for x in bpe.decode(frame, vocabulary).collect()}
    assert got.pop(900) is None
    assert [got[i] for i in range(200)] == library.decode_batch(lists, skip_special_tokens=False)


def test_merges_out_of_order_are_refused():
    letters = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError):
        bpe.ByteBPE.build({**letters, b"ab": 256, b"abc": 257}, [(b"ab", b"c"), (b"a", b"b")], {})


def test_own_vocabulary():
    letters = {bytes([b]): b for b in range(256)}
    own = bpe.ByteBPE.build({**letters, b"aa": 256, b"ab": 257, b"aaab": 258}, [(b"a", b"a"), (b"a", b"b"), (b"aa", b"ab")], {})
    ids, offsets = own.encode(pa.array(["aaab", "aaaab", "ab", "aaaaa"]))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [[258], [256, 256, 98], [257], [256, 256, 97]]


def test_frames(spark, docs, none, vocabulary, library):
    out = bpe.encode(docs, vocabulary, decoded=True)
    rows = out.collect()
    assert len(rows) == docs.count() and set(rows[0]["row"].asDict()) == set(docs.columns)
    for x in rows:
        text = x["row"]["text"]
        assert x["ids"] == (None if text is None else library.encode(text, add_special_tokens=False).ids) and x["decoded"] == text
    assert bpe.encode(none, vocabulary).count() == 0
    again = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    assert again.where("not (decoded <=> row.row.text)").count() == 0


def test_query(spark, small, library):
    from tallymere.llm.queries import QUERIES

    out = {r["doc_id"]: r for r in QUERIES["op11_bpe"](spark, small).collect()}
    for d in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = library.encode(d["text"], add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(out[d["doc_id"]])[1:] == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
