"""Language, personal data, url filter, top-k, tokens and pieces."""

from __future__ import annotations

import itertools
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymere.llm import language, pieces, pii, token_counts, topk, url_filter
from tallymere.plans.scratch import Scratch

# --- language ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(0)
    sets = {"de": ["der", "und", "nicht", "straße", "über"], "es": ["el", "mañana", "señor", "pero", "niño"], "ru": ["привет", "мир", "дом"]}
    rows = [(" ".join(r.choice(w) for _ in range(60)), k) for k, w in sets.items() for _ in range(20)] + [("nothing", None), (None, "de")]
    return language.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_spans_of_a_mixed_text(spark, model):
    text = "der und nicht über straße und nicht. el señor pero mañana el niño señor! привет мир"
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "123 --", "x"), (4, "", "x"), (5, "привет мир", "x")], "doc_id long, text string, lang_pred string")
    out = {r["row"]["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert [(s["lang"], text[s["start"] : s["end"]].split()[0]) for s in out[1]["spans"]] == [("de", "der"), ("es", "el"), ("ru", "привет")]
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (2, 3, 4))
    assert out[5]["lang_pred"] == "ru" and out[5]["score"] == 1.0


def test_language_edges(docs, none, model):
    assert language.identify(docs, model).count() == docs.count()
    assert language.identify(none, model).count() == 0
    untaught = language.learn(none)
    assert {r["lang_pred"] for r in language.identify(docs, untaught).collect()} == {"und"}


def test_best_path_is_the_best_of_all_paths():
    from itertools import product

    r = np.random.default_rng(4)
    for _ in range(40):
        sizes = r.integers(0, 6, 4)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        scores = r.normal(0, 4, (offsets[-1], 3)).astype(np.float32)
        labels = language.best_path(scores, offsets, 3.0)
        value = lambda path, s: sum(s[i, k] for i, k in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
            own = scores[lo:hi]
            best = max(value(p, own) for p in product(range(3), repeat=hi - lo)) if hi > lo else 0
            assert abs(value(labels[lo:hi], own) - best) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs.where(language.held_out()), language.learn(docs.where(~language.held_out())))
    right = found.agg(F.avg((F.col("lang_pred") == F.col("row.lang")).cast("int"))).first()[0]
    assert right > 0.98


def test_many_languages_and_a_script_of_none(spark):
    r = random.Random(5)
    words = {f"l{k:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for k in range(150)}
    rows = [(" ".join(r.choice(own) for _ in range(30)), name) for name, own in words.items() for _ in range(3)]
    taught = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    out = language.identify(spark.createDataFrame([(t, n) for t, n in rows[::3]] + [("привет мир", None)], "text string, lang string"), taught).collect()
    assert all(x["lang_pred"] == x["row"]["lang"] and x["score"] > 0.9 for x in out if x["row"]["lang"]) and len(taught.languages) == 150
    assert [(x["lang_pred"], x["score"]) for x in out if x["row"]["lang"] is None] == [("l000", 0.0)]


def test_rare_languages_are_learnt_from_a_bounded_sample(spark):
    rows = [(f"the and with {i}", "en") for i in range(3000)] + [(f"ñandú mañana señor {i}", "es") for i in range(3)]
    taught = language.learn(spark.createDataFrame(rows, "text string, lang string"), sample_rows=200)
    assert taught.languages == ["en", "es"]


# --- personal data -------------------------------------------------------------------------------------------------


def plain_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(2)
    alphabet = ["a", "b.", "@", "-", "+", " ", "1", "25", "255", "256", ".", "(", ")", "4111111111111111", "é", "x@y.z", "\n", "0001"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text)[0] == plain_spans(text), text


def test_numbers_of_any_length_are_read():
    text = "0" * 4301 + "1.1.1.1"
    assert pii.base_spans(text)[0] == [("ip", 0, len(text))]
    assert not pii.base_spans("9" * 9000 + ".1.1.1")[0] and not pii.base_spans("1" * 9000)[0]


def exact_marginals(n, unary, edges):
    """Marginals of a field by enumeration; edges are (a, b, log potential)."""
    total = np.zeros((n, unary.shape[1]))
    for labels in itertools.product(range(unary.shape[1]), repeat=n):
        p = np.exp(sum(unary[i, k] for i, k in enumerate(labels)) + sum(table[labels[a], labels[b]] for a, b, table in edges))
        for i, k in enumerate(labels):
            total[i, k] += p
    return total / total.sum(1, keepdims=True)


def test_beliefs_equal_enumeration_on_chains_and_are_near_it_on_loops():
    r = np.random.default_rng(4)
    n_labels = len(pii.LABELS)
    weights = pii.Weights(r.normal(size=(pii.SHAPES, n_labels)), r.normal(size=(n_labels, n_labels)), 1.5, 2.0, rounds=60)
    for words, loop in ((["11", "2.2", "33333", "a4"], False), (["555555", "a1", "77", "555555"], True)):
        tokens = pii.tokens_of([" ".join(words)], [[]], [[]])
        unary = pii._features(np.array(tokens.shape)) @ weights.shapes
        edges = [(i, i + 1, weights.transitions) for i in range(3)] + [(a, b, np.eye(n_labels) * weights.skip) for a, b in pii.skip_edges(tokens).tolist()]
        assert (len(edges) == 4) == loop
        assert np.abs(pii.beliefs(tokens, weights) - exact_marginals(4, unary, edges)).max() < (0.1 if loop else 1e-6)


def test_hidden_entities_are_found_by_shape_neighbours_and_twins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null")
    taught = pii.learn(docs.where("doc_id % 2 = 0"))
    hidden = found = other = 0
    for text in [r["text"] for r in docs.where("doc_id % 2 = 1").select("text").collect()]:
        good, bad = pii.base_spans(text)
        gone = [s for s in good if crc32(f"{s}{text[s[1] : s[2]]}".encode()) % 2]
        more = pii.added_spans([text], [[s for s in good if s not in gone]], [bad], taught)[0]
        meets = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
        hidden += len(gone)
        found += sum(any(meets(s, x) for x in more) for s in gone)
        other += sum(not any(meets(s, x) for s in gone) for x in more)
    assert hidden > 100 and found >= 0.95 * hidden and other <= 0.05 * hidden


def test_entities_in_other_spellings_are_added(spark):
    text = "Call +1 (017) 555-7713; later 017-555-7713, or 017 555 7713. Card 4845168114407329, 4845_1681_1440_7329; order 9807915762804490, version 2.0"
    good, bad = pii.base_spans(text)
    taught = pii.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    added = {(k, text[s:e]) for k, s, e in pii.added_spans([text], [good], [bad], taught)[0]}
    assert added == {("phone", "017-555-7713"), ("phone", "017 555 7713"), ("card", "4845_1681_1440_7329")}


def test_variants_of_an_entity_are_added(spark, docs, none):
    text = "mail bo.42@mail8.example.com or BO.42@MAIL8.EXAMPLE.COM, card 4041894974608795, again 4041.8949.7460.8795; bad 4041894974608796, version 3."
    taught = pii.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    out = pii.find(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, spans string"), taught).first()
    base, spans = [{(s["kind"], text[s["start"] : s["end"]]) for s in out[c]} for c in ("base", "spans")]
    assert base <= spans and ("card", "4041.8949.7460.8795") in spans - base and not any("796" in x or x == "3" for _, x in spans)
    assert pii.find(docs, pii.learn(docs)).count() == docs.count() and pii.find(none, pii.learn(none)).count() == 0


# --- url filter ----------------------------------------------------------------------------------------------------


def test_rules_and_model(spark):
    urls = ["http://a.net/", "http://NET", "http://example.net/en/x", "http://q.example.net/en/?a=1", "http://example.net/en", "ftp://example.com/de/1", "x://notexample.com/de/", "http://a.org/fr/", "", None, "no scheme", "http://www.example.com/en/1?a&b#c://d/"]
    rows = [(i, u, "x") for i, u in enumerate(urls)] * 2
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), url_filter.RULES).collect()
    assert len(out) == 24
    by = {r["row"]["page_id"]: r for r in out}
    assert [by[i]["rule"] for i in range(12)] == ["net/", None, "example.net/en/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, None]
    assert (by[11]["host"], by[11]["path"], by[1]["host"], by[1]["path"], by[10]["host"]) == ("www.example.com", "/en/1", "net", "", "")
    assert [by[i]["verdict"] for i in (0, 2, 4, 5, 7)] == ["block", "allow", "block", "block", "allow"]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), url_filter.RULES).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    r = random.Random(1)
    rows = [(f"http://s{i}.shop.biz/{r.randrange(10**9)}/{r.randrange(10**9)}?a=1&b=2&c=3", 1.0) for i in range(150)] + [(f"http://s{i}.school.edu/about/people", 0.0) for i in range(150)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "url string, label double").withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    marked = frame.withColumn("test", F.pmod(F.xxhash64("url"), F.lit(4)) == 0)
    judged = url_filter.train(marked.where("not test")).blocked(marked.where("test"))
    assert judged.agg(F.avg((F.col("blocked") == (F.col("label") == 1)).cast("int"))).first()[0] > 0.95


def test_urls_without_a_rule_teach_nothing(spark):
    """Bad and good hosts differ by their form; most bad-looking urls have no rule and must not be learnt as good."""
    rules = [url_filter.Rule("block", "bad.biz/"), url_filter.Rule("allow", "good.edu/")]
    bad = lambda i, top: f"http://s{i % 60}.{top}/{(i * 7919 + 123456) % 10**6:06}/{(i * 104729 + 123456) % 10**6:06}?a=1&b=2&c=3"
    urls = [bad(i, "bad.biz") for i in range(60)] + [f"http://s{i}.good.edu/about/people" for i in range(60)] + [bad(i, f"ne{i % 10}.org") for i in range(300)] + [f"http://s{i % 60}.fin{i % 10}.org/about/people" for i in range(300)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    verdicts = {r["row"]["page_id"]: r["verdict"] for r in url_filter.judge(frame, rules).collect()}
    assert sum(verdicts[i] == "block" for i in range(120, 420)) > 285
    assert sum(verdicts[i] == "allow" for i in range(420, 720)) > 285
    # labels of one class teach nothing: the others are allowed
    assert {r["verdict"] for r in url_filter.judge(frame.where("page_id >= 120 or page_id < 60"), rules).where("rule is null").collect()} == {"allow"}


# --- top-k ---------------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(5, 6))
    vectors = [(i, [float(x) for x in centres[i % 5] + 0.3 * r.normal(size=6)]) for i in range(400)]
    vectors += [(400 + i, vectors[0][1]) for i in range(30)] + [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, []), (504, [1.0, 2.0]), (505, [float("inf")] * 6)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for row in topk.top_k(frame, F.col("vec_id") % 20 == 0, k=7, block_rows=64, query_rows=16).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    whole = {i: np.floor(64 * np.float32(v).astype(float)).astype(int) for i, v in vectors[:430]}
    for q in [i for i in whole if i % 20 == 0]:
        order = sorted(((-int(whole[q] @ x), i) for i, x in whole.items() if i != q))[:7]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(order)]
    assert 500 not in got and got.keys() <= set(whole)
    assert topk.top_k(frame.where("vec_id < 0"), F.lit(True)).count() == 0


# --- tokens --------------------------------------------------------------------------------------------------------


def test_counts_across_blocks(spark):
    r = random.Random(6)
    for width in (1, 3, 50):
        files, expected = [], []
        for f in range(3):
            stream = [r.choice([7, 8, 9, 0]) for _ in range(r.randint(0, 60))]
            run, ordinal, start = 0, 0, 0
            for at, t in enumerate(stream, 1):
                if t == 0:
                    expected.append((f, ordinal, start, run, True))
                    run, ordinal, start = 0, ordinal + 1, at
                else:
                    run += 1
            if run:
                expected.append((f, ordinal, start, run, False))
            data = np.array(stream, "<u2")
            files += [(f, k, bytearray(data[k * width : (k + 1) * width].tobytes())) for k in range((len(stream) + width - 1) // width)]
        frame = spark.createDataFrame(files, "file int, no long, data binary").repartition(3)
        got = token_counts.count_tokens(frame, Scratch(spark, "t"), separator=0)
        assert sorted(tuple(x) for x in got.collect()) == sorted(expected)


def test_documents_and_files(spark, docs, none, tmp_path):
    encoding = token_counts.load_encoding()
    for frame in (docs, none):
        scratch = Scratch(spark, "t")
        stream, order = token_counts.write_token_blocks(frame, encoding, scratch, block_tokens=64)
        out = token_counts.count_tokens(stream, scratch).join(order, ["file", "ordinal"])
        got = sorted(((r["doc_id"], r["n_tokens"]) for r in out.collect()), key=str)
        assert got == sorted(((r["doc_id"], len(encoding.encode_ordinary(r["text"] or ""))) for r in frame.collect()), key=str)
    named = spark.createDataFrame([("a", "one two"), (None, "three")], "doc_id string, text string")
    stream, order = token_counts.write_token_blocks(named, encoding, Scratch(spark, "t"))
    assert {r["doc_id"] for r in order.collect()} == {"a", None} and stream.count() >= 1
    tokens = np.array([5, 6, 9, 9, 5, 9, 4], "<u2")
    (tmp_path / "a.bin").write_bytes(tokens.tobytes())
    found = token_counts.count_tokens(token_counts.read_token_files(spark, str(tmp_path), block_bytes=4), Scratch(spark, "t"), separator=9)
    assert sorted((r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in found.collect()) == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, True), (3, 6, 1, False)]


# --- pieces --------------------------------------------------------------------------------------------------------


def best_score(text, scores, unknown):
    marked = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-np.inf] * len(marked)
    for j in range(1, len(marked) + 1):
        for size in range(1, min(8, j) + 1):
            piece = marked[j - size : j]
            if piece in scores:
                best[j] = max(best[j], best[j - size] + scores[piece])
        if marked[j - 1] not in scores:
            best[j] = max(best[j], best[j - 1] + unknown)
    return best[-1]


def test_paths_are_best_and_round_trip():
    r = random.Random(8)
    alphabet = "ab c"
    names = ["▁", "a", "b", "▁a", "▁b", "▁▁"] + list({"".join(r.choice("abab") for _ in range(r.randint(2, 6))) for _ in range(30)}) + ["▁ab", "▁aba"]
    byte_pieces = [f"<0x{i:02X}>" for i in range(256)]
    scores = [0.0] * 256 + [-r.random() * 9 for _ in names]
    model = pieces.Pieces.build(byte_pieces + names, scores, [False] * 256 + [True] * len(names), 0)
    table = dict(zip(names, scores[256:], strict=True))
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 25))) for _ in range(300)] + ["é\n\U0001F600 ab", "   "]
    ids, offsets = model.encode(pa.array(texts))
    assert model.decode(ids, offsets) == texts
    for i, text in enumerate(texts[:300]):
        own = ids[offsets[i] : offsets[i + 1]]
        got = sum(scores[k] if k >= 256 else model.unknown_score for k in own)
        assert abs(got - best_score(text, table, model.unknown_score)) < 1e-6, text


@pytest.mark.parametrize("crossing", [False, True])
def test_text_without_spaces_and_pieces_across_spaces(crossing):
    r = random.Random(9)
    names = ["▁", "a", "b", "c", "▁a", "bb", "abb", "ccc"] + ["a▁b", "bb▁"] * crossing
    scores = [0.0] * 256 + [-r.random() * 9 for _ in names]
    model = pieces.Pieces.build([f"<0x{i:02X}>" for i in range(256)] + names, scores, [False] * 256 + [True] * len(names), 0)
    assert model._splits_before_spaces() != crossing
    table = dict(zip(names, scores[256:], strict=True))
    texts = ["".join(r.choice("aabbbc" + " " * (k % 3 == 0)) for _ in range(r.choice([3, 40, 90, 400]))) for k in range(120)]
    ids, offsets = model.encode(pa.array(texts))
    assert model.decode(ids, offsets) == texts
    for i, text in enumerate(texts):
        assert abs(sum(scores[k] for k in ids[offsets[i] : offsets[i + 1]]) - best_score(text, table, model.unknown_score)) < 1e-6, text
    mixed = ["漢字é" * 500, "a" * 1000 + "漢" + "b" * 300]
    assert model.decode(*model.encode(pa.array(mixed))) == mixed


def test_pieces_of_the_vocabulary(spark, docs, none):
    model = pieces.Pieces.load()
    out = pieces.encode(docs, model, decoded=True).collect()
    assert all(r["decoded"] == r["row"]["text"] for r in out) and len(out) == docs.count()
    apart = pieces.decode(pieces.encode(docs, model), model).collect()
    assert sorted(str(r["decoded"]) for r in apart) == sorted(str(r["decoded"]) for r in out)
    assert pieces.encode(none, model).count() == 0
    marked = pieces.encode(spark.createDataFrame([("a▁b",)], "text string"), model, decoded=True).first()
    assert marked["decoded"] == "a b"
