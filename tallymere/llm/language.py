"""Language identification with spans.

Learning counts hashed letter pairs and triples by language.  For prediction,
the script of a word (fixed ranges of code points) narrows the languages that
can have produced it, each word gets a log-likelihood under every language,
and a Viterbi pass over the words with a penalty for each switch labels the
spans of a mixed text.  The language of a text is the one with most letters;
its score is its share of all letters, where words in a script that no language
is written in speak for none.

The model has a fixed size for each language.  Learning reads a sample that
``sample_rows`` bounds; prediction works on blocks of whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score
0; rows with a null label teach nothing; with nothing to learn from, all texts
are ``und``; ties go to the language that sorts first, also for a text in a
script of no language, whose score is 0.  Input columns are kept
inside the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import distinct_sample
from .texthash import blocks, bounded_batches, by_blocks, mix

UNKNOWN = "und"
BUCKETS = 1 << 16
BLOCK_BYTES = 3 << 18

# First code points of script ranges, with the script that starts there.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0F00, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([at for at, _ in SCRIPT_STARTS])
_SCRIPT_OF_RANGE = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS], np.int8)
_BASIC = 1 << 16
_tables: tuple[np.ndarray, np.ndarray] | None = None


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each basic code point: whether it is a letter, and its lower case."""
    global _tables
    if _tables is None:
        letter, lower = np.zeros(_BASIC, bool), np.arange(_BASIC, dtype=np.uint32)
        for i in range(_BASIC):
            if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
                letter[i] = True
                low = chr(i).lower()
                lower[i] = ord(low) if len(low) == 1 and ord(low) < _BASIC else i
        _tables = letter, lower
    return _tables


@dataclass
class Words:
    """Words (runs of letters) of a block of texts. Place: in code points of the text."""

    offsets: np.ndarray  #: text i has words offsets[i] to offsets[i + 1]
    start: np.ndarray
    size: np.ndarray
    script: np.ndarray
    grams: np.ndarray  #: buckets of the letter pairs and triples, word after word
    gram_offsets: np.ndarray


def words_of(text: pa.Array) -> Words:
    letter_of, lower_of = _letter_tables()
    texts = [x or "" for x in text.to_pylist()]
    ends = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    basic = np.minimum(code, _BASIC - 1)
    letter = letter_of[basic] & (code < _BASIC)
    for rare in np.unique(code[code >= _BASIC]):
        if chr(rare).isalpha():
            letter |= code == rare
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    offsets = np.searchsorted(start, ends)
    # a gram ends at each letter and at the place after the word
    c = np.where(letter, np.where(code < _BASIC, lower_of[basic], code), 0).astype(np.uint64)
    c = np.concatenate([np.zeros(2, np.uint64), c, np.zeros(1, np.uint64)])
    size = stop - start
    at = np.repeat(start, size + 1) + _ranges(size + 1)
    last, middle = c[at + 2], c[at + 1]
    first = np.where(middle == 0, np.uint64(0), c[at])
    pair = middle * np.uint64(1 << 21) + last
    both = np.stack([pair + np.uint64(1 << 63), pair + first * np.uint64(1 << 42)], 1)
    grams = (mix(both) & np.uint64(BUCKETS - 1)).astype(np.int32).ravel()
    script = _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, code[start], "right") - 1] if len(start) else np.zeros(0, np.int8)
    doc = np.searchsorted(ends, start, "right") - 1
    return Words(offsets, start - ends[doc], size, script, grams, np.concatenate([[0], np.cumsum(2 * (size + 1))]))


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@dataclass
class Model:
    languages: list[str]
    gram_scores: np.ndarray  #: buckets by languages, log-probabilities
    allowed: np.ndarray  #: scripts by languages
    switch_penalty: float = 12.0
    foreign_score: float = -20.0  #: of a word in a script that the language isn't written in


def learn(
    labelled: DataFrame, text: str = "text", label: str = "lang", sample_rows: int = 20_000,
    min_script_share: float = 0.001, smoothing: float = 0.5, switch_penalty: float = 12.0,
) -> Model:
    """Learn from different texts with a label, about ``sample_rows`` at most: about an equal part of these for each language,
    chosen by a hash of the text, so that rare languages are taken whole.

    What reaches the driver is one count for each language and bucket.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("string").alias("label")).where("text is not null and label is not null")
    rows = distinct_sample(rows, "text", sample_rows, "label", equal=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo, hi in blocks(batch["text"], BLOCK_BYTES):
                part = batch.slice(lo, hi - lo)
                for name in pc.unique(part["label"]).to_pylist():
                    found = words_of(part.filter(pc.equal(part["label"], name))["text"])
                    total = sums.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS)))
                    total[:BUCKETS] += np.bincount(found.grams, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(found.script, found.size, minlength=len(SCRIPTS))
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"label": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": total[at]})

    counts = rows.mapInArrow(count, "label string, bucket int, n double").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["label"].unique())
    table = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    table[counts["bucket"], np.searchsorted(languages, counts["label"]) if languages else []] = counts["n"]
    grams, letters = table[:BUCKETS] + smoothing, table[BUCKETS:]
    scores = np.log(grams / grams.sum(0))
    if languages:
        scores -= scores.mean(1, keepdims=True)
    return Model(languages, scores.astype(np.float32), letters > min_script_share * letters.sum(0), switch_penalty)


def best_path(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """For each word the language on the path with the highest sum of scores less penalties; texts are independent."""
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    sums = np.zeros((len(counts), scores.shape[1]))
    full = np.flatnonzero(counts)
    sums[full] = np.add.reduceat(scores, offsets[full], axis=0) if len(full) else 0
    alone = sums.argmax(1)
    labels = alone[doc].astype(np.int32)
    # No path with switches beats the best language alone if no stretch gains more than half a penalty by leaving it.
    gain = scores - np.take_along_axis(scores, labels[:, None].astype(int), 1)
    total = np.cumsum(gain, axis=0, dtype=np.float64)
    lift = doc[:, None] * (1 + 2 * np.abs(total).max(initial=0.0))
    before = np.minimum.accumulate(np.concatenate([total[:0], total - gain]) - lift, axis=0)
    stretch = (total - lift - before).max(1, initial=0.0)
    peak = np.zeros(len(counts))
    np.maximum.at(peak, doc, stretch)
    mixed = np.flatnonzero(peak > penalty / 2)
    mixed = mixed[np.argsort(-counts[mixed], kind="stable")]
    if not len(mixed):
        return labels
    sizes, base = counts[mixed], offsets[mixed]
    came = np.zeros(scores.shape, np.int32)
    own = np.arange(scores.shape[1], dtype=np.int32)
    value = scores[base].astype(np.float64)
    open_at = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # texts with more than t words
    for t in range(1, sizes[0]):
        k = open_at[t]
        at = base[:k] + t
        old = value[:k]
        arg = old.argmax(1)
        switched = old[np.arange(k), arg][:, None] - penalty
        stay = old >= switched
        came[at] = np.where(stay, own, arg[:, None])
        value[:k] = np.where(stay, old, switched) + scores[at]
    now = value.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        k = open_at[t]
        at = base[:k] + t
        labels[at] = now[:k]
        now[:k] = came[at, now[:k]]
    return labels


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Columns row (struct of the input's columns), lang_pred, score, spans (lang, start, end; code points, end exclusive)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size for each language
    names = np.array([*model.languages, UNKNOWN])
    n_lang = len(model.languages)

    def label(part: pa.RecordBatch) -> pa.RecordBatch:
        found = words_of(pc.struct_field(part["row"], text))
        n, counts = part.num_rows, np.diff(found.offsets)
        if not n_lang or not len(found.start):
            empty = pa.array([[]] * n, span_type)
            return pa.RecordBatch.from_arrays([part["row"], pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), empty], ["row", "lang_pred", "score", "spans"])
        own = shared.value
        scores = np.add.reduceat(own.gram_scores[found.grams], found.gram_offsets[:-1], axis=0)
        allowed = own.allowed[found.script]
        scores = np.where(allowed, scores, np.float32(own.foreign_score))
        labels = best_path(scores, found.offsets, own.switch_penalty)
        doc = np.repeat(np.arange(n), counts)
        written = found.size * allowed[np.arange(len(doc)), labels]  # a word in a script of no language speaks for none
        letters = np.bincount(doc * n_lang + labels, written, minlength=n * n_lang).reshape(n, n_lang)
        top = letters.argmax(1)
        share = letters[np.arange(n), top] / np.maximum(np.bincount(doc, found.size, minlength=n), 1)
        top[counts == 0] = n_lang
        # a span starts where the text or the label changes
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(doc)) - 1
        items = pa.StructArray.from_arrays([pa.array(names[labels[head]]), pa.array(found.start[head]), pa.array(found.start[tail] + found.size[tail])], ["lang", "start", "end"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc[head], minlength=n))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([part["row"], pa.array(names[top]), pa.array(share), pa.ListArray.from_arrays(pa.array(ends), items)], ["row", "lang_pred", "score", "spans"])

    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a word takes memory for each language
        return by_blocks(batches, lambda batch: pc.struct_field(batch["row"], text), label, max(1 << 14, 4 * BLOCK_BYTES // max(4, n_lang)))

    bounded_batches(docs.sparkSession)
    row = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {row}, lang_pred string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>")


def held_out(doc_id: str = "doc_id"):
    """A third of the identifiers, never learnt from. A null identifier isn't held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3)) == 1


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
