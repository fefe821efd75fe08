"""Hashing, near duplicates, sharding, line chunks and benchmark items against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tallymere.llm import decontaminate, line_dedup, ngram_join, sharding, texthash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return Counter((i, len(s), least.get(top(k), i) if s else i) for k, (i, s) in enumerate(sets))


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    originals = [[r.choice(vocabulary) for _ in range(r.randint(3, 90))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        text = list(r.choice(originals))
        for _ in range(r.randint(0, 4)):
            text[r.randrange(len(text))] = r.choice(vocabulary)
        rows.append((i, " ".join(text)))
    return rows


def test_shingles_are_sets_of_word_runs():
    texts = ["a b c d e f", "A  b\tc\nd e f", "a b", "a", None, "", "b a", "a b c d e a b c d e a b c d e"]
    hashes, offsets = texthash.shingle_sets(pa.array(texts))
    got = [set(hashes[offsets[i] : offsets[i + 1]].tolist()) for i in range(len(texts))]
    assert [len(x) for x in got] == [len(shingles(t)) for t in texts]
    assert got[0] == got[1] and got[2] != got[6] and not got[4] and not got[5]


def test_words_of_two_letters_in_any_pattern_differ():
    first = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = first.translate(str.maketrans("ab", "ba"))
    hashes, _ = texthash.word_hashes(pa.array([first, other, first[:512], first[:511] + "c", "a" * 1024]))
    assert len(set(hashes.tolist())) == 5


def groups(frame):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect())


def near_copies(seed, n, size=200):
    """Copies of a text that is not among them: two or three words of each are changed, so two copies have a Jaccard index of about 0.7 to 0.85."""
    r = random.Random(seed)
    original = [f"w{r.randrange(10**6)}" for _ in range(size)]
    rows = []
    for i in range(n):
        text = list(original)
        for at in r.sample(range(size), r.choice([2, 3])):
            text[at] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    return rows


def test_joined_rows_grow_with_a_group_of_near_copies(spark, monkeypatch):
    made = Counter()
    save = ngram_join.Scratch.save

    def counted(self, frame, name, *rest):
        out = save(self, frame, name, *rest)
        if "pairs" in name or name == "meets":
            made[n] += out.count()
        return out

    monkeypatch.setattr(ngram_join.Scratch, "save", counted)
    for n in (150, 600):
        rows = near_copies(3, n)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert groups(ngram_join.near_duplicates(docs)) == brute_groups(rows)
    assert made[600] <= 6 * made[150]


def test_near_duplicates_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert groups(ngram_join.near_duplicates(docs)) == brute_groups(rows)


def test_near_duplicates_edges(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert groups(ngram_join.near_duplicates(docs)) == brute_groups(rows)
    assert ngram_join.near_duplicates(none).count() == 0


def test_one_of_each_group_stays(docs):
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=lambda x: (x is None, x)) == [0, 3, 4, 5, 6, 8, 9, None]
    named = docs.select(docs["doc_id"], "text", F.lit(1).alias("code"), F.lit("x").alias("drop_doc_id"), F.lit(2).alias("check"), F.lit(3).alias("bad_id"))
    copy = named.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long"))
    kept = ngram_join.keep_one(named.union(copy))
    assert kept.columns == named.columns and sorted(r["doc_id"] is None for r in kept.collect()) == sorted(r["doc_id"] is None for r in left.collect())
    clean = decontaminate.keep(named, docs.where("doc_id = 9").select(F.lit(1).alias("item_id"), "text"))
    assert clean.columns == named.columns and clean.count() == named.count() - 1


def test_shards_are_even_gapless_and_repeatable(spark, docs, none):
    many = spark.createDataFrame([(i, f"text {i % 7}") for i in range(1000)], "doc_id long, text string")
    run = lambda d: sharding.shuffle_to_shards(d, 8, bucket_bytes=900)
    rows = run(many).select("row.doc_id", "shard", "slot", "bucket").collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 1000 and max(sizes.values()) - min(sizes.values()) <= 1 and len({r["bucket"] for r in rows}) > 5
    for shard in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sizes[shard]))
    assert set(rows) == set(run(many.repartition(5)).select("row.doc_id", "shard", "slot", "bucket").collect())
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["shard"]))]
    assert order != sorted(order) and sorted(order) == list(range(1000))
    assert run(docs).count() == docs.count() and run(none).count() == 0
    assert run(docs).select("row.*").columns == docs.columns


def without_passages(rows, lines_only=False):
    """Plain version: by doc_id, the text that stays, its lines, and how many went; or the (doc_id, line) that go."""
    first, own, goes, stays = {}, {i: text.split("\n") for i, text in rows}, set(), set()
    for i in sorted(own):
        runs, open_ = [], {}  # open_: by source and shift, the run that may go on
        for k, pair in enumerate(zip(own[i], own[i][1:])):
            source, at = first.setdefault(pair, (i, k))
            if (source, at) == (i, k):
                continue
            run = open_.get((source, k - at))
            if run and k <= run["hi"] + 1:  # windows k - 2 or k - 1 were its last
                run["hi"] = k + 1
            else:
                open_[source, k - at] = run = {"lo": k, "hi": k + 1, "source": source, "shift": k - at}
                runs.append(run)
        best = {}
        for run in sorted(runs, key=lambda x: (x["lo"] - x["hi"], x["lo"])):
            for line in range(run["lo"], run["hi"] + 1):
                best.setdefault(line, run)
        parts = []
        for line in sorted(best):
            if parts and parts[-1][-1] == line - 1 and best[line - 1] is best[line]:
                parts[-1].append(line)
            else:
                parts.append([line])
        parts = [p for p in parts if len(p) > 1]
        ends = {p[-1] for p in parts}
        parts = [p[1:] if p[0] - 1 in ends else p for p in parts]  # of two that touch, the later one's first line stays
        for part in parts:
            if len(part) > 1:
                run = best[part[0]]
                goes |= {(i, x) for x in part}
                stays |= {(run["source"], x - run["shift"]) for x in part}
    goes -= stays
    goes = {(i, k) for i, k in goes if (i, k - 1) in goes or (i, k + 1) in goes}
    return goes if lines_only else {i: ("\n".join(x for k, x in enumerate(lines) if (i, k) not in goes), len(lines), sum((i, k) in goes for k in range(len(lines)))) for i, lines in own.items()}


def test_what_goes_stands_whole_elsewhere(spark):
    """Passages whose pairs of lines are spread over other documents are not torn."""
    run = lambda texts: {r["row"]["doc_id"]: r["text"] for r in line_dedup.remove_repeated_passages(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert run(["z\na", "z\na\nb", "a\nb"]) == {0: "z\na", 1: "z\na\nb", 2: ""}
    out = run(["a\nb", "b\nc", "c\nd", "q\na\nb\nc\nd\nr"])
    assert out == {0: "a\nb", 1: "b\nc", 2: "c\nd", 3: "q\nc\nd\nr"}
    # one window inside is older than the rest: the passage goes whole, with one source
    assert run(["b\nc", "a\nb\nc\nd", "x\na\nb\nc\nd\ny"])[2] == "x\ny"


def test_every_removed_run_of_the_tables_stands_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = {r["row"]["doc_id"]: r for r in line_dedup.remove_repeated_passages(docs).collect()}
    rows = [(i, r["row"]["text"]) for i, r in out.items()]
    expected = without_passages(rows)
    assert all((r["text"], r["n_lines"], r["n_removed"]) == expected[i] for i, r in out.items())
    goes = without_passages(rows, lines_only=True)
    kept = "\x00".join(f"\n{r['text']}\n" for r in out.values())
    runs = 0
    for i, text in rows:
        lines = text.split("\n")
        for lo in range(len(lines)):
            if (i, lo) in goes and (i, lo - 1) not in goes:
                hi = next(k for k in range(lo, len(lines) + 1) if (i, k) not in goes)
                runs += 1
                assert "\n" + "\n".join(lines[lo:hi]) + "\n" in kept
    assert runs > 100


def test_line_dedup_removes_planted_passages_whole(spark):
    """Passages of 2 to 6 lines between lines of their own: all lines go everywhere but at the first place."""
    r = random.Random(11)
    passages = [[f"passage {p} line {k}" for k in range(2 + p % 5)] for p in range(40)]
    rows, seen, expected = [], set(), {}
    for i in range(200):
        p = r.randrange(40)
        before, after = [f"before {i} {k}" for k in range(r.randint(0, 3))], [f"after {i} {k}" for k in range(r.randint(0, 3))]
        rows.append((i, "\n".join(before + passages[p] + after)))
        expected[i] = "\n".join(before + ([] if p in seen else passages[p]) + after)
        seen.add(p)
    out = line_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["row"]["doc_id"]: r["text"] for r in out} == expected


def test_line_dedup_equals_plain_version(spark, docs, none):
    r = random.Random(12)
    rows = [(i, "\n".join(r.choice(["", "a", "b", "c", "d", *[f"own {i} {k}" for k in range(4)]]) for _ in range(r.randint(1, 14)))) for i in range(120)]
    rows += [(200, "x\nx\nx\nx"), (201, "one"), (202, "one"), (203, "")]
    out = line_dedup.remove_repeated_passages(spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(4)).collect()
    expected = without_passages(rows)
    assert len(out) == len(rows) + 3
    assert all((r["text"], r["n_lines"], r["n_removed"]) == expected[r["row"]["doc_id"]] for r in out)
    out = {(r["row"]["doc_id"], r["row"]["text"]): r for r in line_dedup.remove_repeated_passages(docs).collect()}
    assert out[3, None]["text"] is None and out[3, None]["n_lines"] == 0 and out[4, ""]["text"] == "" and out[4, ""]["n_lines"] == 1
    assert line_dedup.remove_repeated_passages(none).count() == 0


def brute_contamination(docs, items):
    out = []
    for i, text in docs:
        for k, item in items:
            own = shingles(item)
            if own and len(own & shingles(text)) * 100 >= 80 * len(own):
                out.append((i, k, len(own), len(own & shingles(text))))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark, docs, none):
    r = random.Random(3)
    items = [(k, " ".join(f"b{r.randrange(400)}" for _ in range(r.choice([1, 3, 5, 6, 9, 30, 55])))) for k in range(25)] + [(90, ""), (91, None), (92, items_text := "one two three four five six")]
    items += [(None, items[3][1]), (4, items[6][1] + " and more words of its own"), (7, items[7][1])]
    rows = corpus(9, 60)
    for i in range(60):
        own = (r.choice(items[:25])[1] or "").split()
        for _ in range(r.randint(0, 2)):
            own[r.randrange(len(own))] = "changed"
        rows.append((100 + i, " ".join([*rows[i][1].split(), *own, "tail", "words"])))
    rows += [(200, items[0][1].upper()), (201, items_text)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = lambda d: sorted((tuple(x) for x in decontaminate.contamination(d, benchmark).collect()), key=str)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(frame) == brute_contamination(rows, items) and len(found(frame)) > 20
    assert found(docs) == brute_contamination([(x["doc_id"], x["text"]) for x in docs.collect()], items)
    assert found(none) == []
    assert decontaminate.contamination(docs, benchmark.where("item_id < 0")).count() == 0
    kept = decontaminate.keep(docs, benchmark)
    assert kept.columns == docs.columns and {0, 1, 2}.isdisjoint(x["doc_id"] for x in kept.collect()) and kept.where(F.col("doc_id").isNull()).count() == 1
