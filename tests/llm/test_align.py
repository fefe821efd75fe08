"""Alignment of two vocabularies against a plain walk over the libraries' own tokens of whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallymere.llm import align, bpe

PARTS = ["word", "words", " ", "  ", "   ", "\n", "\n\n", "\t", "é", "漢字", "漢", "😀", "aaaa", "aaaaaaa", "the", "'s", "don't", "1234", "...", "--", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "　", "\x00", "\x1c", "ﬁ", "é", "Ünïcode"]


@pytest.fixture(scope="module")
def sides():
    return bpe.ByteBPE.load(), align.PieceModel.load()


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(bpe.vocabulary_path())
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path(align.MODEL))
    byte = {ch: b for ch, b in bpe._byte_letters().items()}

    def tokens(text):
        if not text:
            return [], []
        a = [(i, bytes(byte[ch] for ch in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(two.id_to_piece(i)[3:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(text)]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    return tokens


def expected(texts, tokens):
    """By text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    found, counts = [], Counter()
    for text in texts:
        sides = []
        for side in tokens(text):
            ends = np.cumsum([len(x) for _, x in side]).tolist()
            sides.append([(i, lo, hi) for (i, _), lo, hi in zip(side, [0, *ends[:-1]], ends)] if side else [])
        a, b = sides
        cuts = sorted({hi for _, _, hi in a} & {hi for _, _, hi in b})
        groups = ";".join("|".join(",".join(str(i) for i, x, y in side if lo < y <= hi) for side in sides) for lo, hi in zip([0, *cuts[:-1]], cuts))
        links, j = [], 0
        for i, lo, hi in a:
            while b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                links.append((i, b[k][0]))
                k += 1
        counts.update(links)
        found.append((len(a), len(b), len(cuts), links, groups))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(n_a, n_b, n_g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), groups) for n_a, n_b, n_g, links, groups in found]


def texts(seed, n, size):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) + r.choice(["", " ", " "]) for _ in range(r.randint(0, size))) for _ in range(n)]


def opened(block):
    """The lists of a block's row."""
    import pyarrow as pa

    row = block.to_pylist()[0]
    return {**pa.ipc.open_stream(row["body"]).read_all().to_pylist()[0], "pairs": row["pairs"]}


def compare(spark, sides, plain, rows, partitions=3):
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(partitions)
    got = {r["row"]["doc_id"]: tuple(r)[1:] for r in align.align(frame, *sides).collect()}
    wanted = expected(rows, plain)
    for i, x in enumerate(wanted):
        assert got[i] == x, rows[i]
    assert len(got) == len(rows)


@pytest.mark.parametrize("sent", [1 << 20, 5])
def test_equals_a_plain_walk(spark, sides, plain, monkeypatch, sent):
    """With the totals of all pairs in every task, and with each block's own by a shuffle."""
    monkeypatch.setattr(align, "SENT_PAIRS", sent)
    rows = texts(1, 400, 12) + texts(2, 40, 200) + [None, "", " ", "  ", "x ", "x  ", " x", "\n x", "with ▁ mark", "a▁", "same text", "same text", "漢" * 2000, "a" * 5000, " ".join(["one"] * 3000), "x" + "  y" * 50, "end\n"]
    compare(spark, sides, plain, rows)


def test_parts_are_cut_and_forgotten_without_effect(spark, sides, plain, monkeypatch):
    """Small blocks, small calls and a small memory, inside this process."""
    import pyarrow as pa

    rows = texts(5, 120, 30) + ["xy" * 3000]
    whole = align.Parts(*sides)
    monkeypatch.setattr(align, "KNOWN_PARTS", 5)
    monkeypatch.setattr(align, "CALL", 40)
    monkeypatch.setattr(align, "ENCODED", 100)
    few = align.Parts(*sides)
    ids = pa.StructArray.from_arrays([pa.array(range(len(rows)))], ["doc_id"])
    for lo in range(0, len(rows), 7):
        own = pa.array(rows[lo : lo + 7])
        one, two = (opened(next(align._blocks(ids.slice(lo, len(own)), own, met))) for met in (whole, few))
        assert sorted((p["a"], p["b"], p["n"]) for p in one["pairs"]) == sorted((p["a"], p["b"], p["n"]) for p in two["pairs"])
        spelt = lambda x: ([x["spelt"][k] for k in x["place"]], x["n_parts"])
        assert spelt(one) == spelt(two)


def test_long_parts_take_no_square(sides):
    """Two vocabularies whose tokens end together nowhere for long."""
    import time

    import pyarrow as pa

    met = align.Parts(*sides)
    began = time.time()
    text = "".join(random.Random(0).choice("abcdefgh0123") for _ in range(400_000))
    block = opened(next(align._blocks(pa.StructArray.from_arrays([pa.array([0])], ["doc_id"]), pa.array([text]), met)))
    assert len(block["spelt"]) == 1 and sum(block["n_links"]) > 200_000 and time.time() - began < 60


def test_frames(spark, docs, none, sides, plain):
    out = align.align(docs, *sides)
    rows = out.collect()
    assert set(rows[0]["row"].asDict()) == set(docs.columns) - {"text"} and len(rows) == docs.count()
    data = docs.collect()
    wanted = Counter(zip([r["doc_id"] for r in data], expected([r["text"] for r in data], plain)))
    assert Counter((r["row"]["doc_id"], tuple(r)[1:]) for r in rows) == wanted
    assert align.align(none, *sides).count() == 0
    assert align.align(docs.where("text is null").select("text"), *sides).select("n_a", "groups").collect() == [(0, "")]


def test_query(spark, small, plain):
    from tallymere.llm.queries import QUERIES

    data = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    wanted = dict(zip([r["doc_id"] for r in data], expected([r["text"] for r in data], plain)))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_token_alignment"](spark, small).collect()}
    assert got == {i: (*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[0] else "") for i, x in wanted.items()}
