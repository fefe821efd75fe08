"""Personal data by patterns and a skip-chain conditional random field.

Patterns with validation give the base spans of four kinds.  The field labels
the tokens that hold a digit or an @; its potentials are shapes of tokens,
transitions between neighbours, and skip edges between distant tokens that are
repeated or similar (equal when reduced to letters and digits; equal long
numbers, also over several tokens, or equal last digits of them; the name part
of an address).  Base spans are evidence.  Loopy message passing spreads it,
so tokens that no pattern takes, because of how they are written or of what
stands next to them, are labelled by their shape, neighbours and twins; those
with a label of more than ``least`` belief are added as spans.

The weights maximise the pseudo-likelihood of the base labels over a sample
that ``sample_rows`` bounds.  For a random half of the base spans the evidence
is hidden there, so that shapes, neighbours and twins have to explain them.
What reaches the driver are counts of the different situations of a token.
Occurrences of a key are chained, so the number of edges is linear in the
tokens.  Every text is handled whole, in blocks, by one pass of array
operations over all of a block's graphs.

Defined results: a null or empty text has no spans; positions are code points;
numbers of any length are read (leading zeros of an address part don't count);
repeated rows get equal results; columns other than the text are kept inside
the struct ``row`` and not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import distinct_sample
from .texthash import bounded_batches, by_blocks

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

# The patterns of the base spans, with starts limited to where a leftmost match can begin.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<![^\s])[^\s0-9@]*[0-9@][^\s]*")
NOT_DIGIT = re.compile(r"[^0-9]+")
EDGE = " \t\r\n.,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; each @ is looked at once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1, start):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            out.append((start, done))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int]]]:
    """Valid spans by kind and start; and (start, end, kind number) of matches that failed."""
    good, bad = [("email", *x) for x in emails(text)], []
    for m in ADDRESS.finditer(text):
        ok = all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))
        good.append(("ip", *m.span())) if ok else bad.append((*m.span(), 2))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        ok = 16 <= len(digits) <= 19 and luhn(digits)
        if ok:
            good.append(("card", *m.span()))
        elif len(digits) >= 12:  # short numbers are no failed cards
            bad.append((*m.span(), 3))
    for m in PHONE.finditer(text) if "+" in text else ():
        ok = 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15
        good.append(("phone", *m.span())) if ok else bad.append((*m.span(), 4))
    return good, bad


@dataclass
class Tokens:
    """Tokens of the texts of a block."""

    doc: list[int]
    start: list[int]
    end: list[int]
    shape: list[int]  #: bits of features
    label: list[int]  #: of the base span that it lies in
    span: list[int]  #: start of that span, or -1
    keys: list[tuple]  #: (text, kind, key, token, first token of the occurrence) for skip edges


SHAPES = 20


def _shape(text: str, start: int, end: int, digits: int, failed: int) -> int:
    word = text[start:end]
    letters = sum(c.isalpha() for c in word)
    flags = [
        True, "@" in word, word.count(".") == 3 and letters == 0, word.startswith("+"), letters > 0, letters > digits,
        digits == 0, 1 <= digits <= 2, 3 <= digits <= 4, 5 <= digits <= 6, 7 <= digits <= 9, 10 <= digits <= 15, 16 <= digits <= 19, digits > 19,
        failed == 2, failed == 3, "." in word, "-" in word, start > 0 and text[start - 1] == "(", end < len(text) and text[end] == ")",
    ]
    return sum(1 << i for i, on in enumerate(flags) if on)


def _number_keys(digits: str) -> list[tuple[str, str]]:
    """A number of 7 to 19 digits meets those that are equal, or whose last 10 or 7 digits are."""
    return [("d", digits), *[(f"d{n}", digits[-n:]) for n in (10, 7) if len(digits) >= n]] if 7 <= len(digits) <= 19 else []


def tokens_of(texts: list[str | None], spans: list, fails: list) -> Tokens:
    out = Tokens([], [], [], [], [], [], [])
    for d, text in enumerate(texts):
        if not text:
            continue
        own = sorted((s, e, KINDS.index(k) + 1) for k, s, e in spans[d])
        bad = sorted(fails[d])
        at = at_bad = 0
        run: list[int] = []  # neighbouring tokens of digits alone

        def close(run=run, d=d, text=text) -> None:
            if len(run) > 1:
                joined = "".join(NOT_DIGIT.sub("", text[out.start[i] : out.end[i]]) for i in run)
                out.keys.extend((d, *key, i, run[0]) for key in _number_keys(joined) for i in run)
            run.clear()

        for m in TOKEN.finditer(text):
            word = m[0].strip(EDGE)
            if not word:
                continue
            start = m.start() + m[0].index(word)
            end = start + len(word)
            while at < len(own) and own[at][1] <= start:
                at += 1
            while at_bad < len(bad) and bad[at_bad][1] <= start:
                at_bad += 1
            inside = at < len(own) and own[at][0] < end
            failed = bad[at_bad][2] if at_bad < len(bad) and bad[at_bad][0] < end else 0
            digits = NOT_DIGIT.sub("", word)
            i = len(out.doc)
            values = (d, start, end, _shape(text, start, end, len(digits), failed), own[at][2] if inside else 0, own[at][0] if inside else -1)
            for field, x in zip((out.doc, out.start, out.end, out.shape, out.label, out.span), values, strict=True):
                field.append(x)
            lower = word.lower()
            out.keys.append((d, "w", "".join(c for c in lower if c.isalnum()), i, i))
            out.keys.extend((d, *key, i, i) for key in _number_keys(digits))
            if "@" in lower:
                name = lower.partition("@")[0]
                if len(name) >= 5:
                    out.keys.append((d, "w", "".join(c for c in name if c.isalnum()), i, i))
            if run and (start - out.end[run[-1]] > 2 or len(run) == 8):
                close()
            if digits and not any(c.isalpha() or c == "@" for c in word):
                run.append(i)
            else:
                close()
        close()
    return out


def skip_edges(tokens: Tokens) -> np.ndarray:
    """Different pairs of tokens: each occurrence of a key with the one before it; neighbours are left to the chain.

    The tokens of a number in parts are one occurrence, and each is tied to the one before.
    """
    last: dict[tuple, tuple[int, int, int]] = {}  # key: start of its last occurrence, end of that, end of the one before
    pairs = set()
    for d, kind, key, i, start in tokens.keys:
        if len(key) >= 5:
            own, end, before = last.get((d, kind, key), (-1, -1, -1))
            if own != start:
                before = end
            if 0 <= before < i - 1:
                pairs.add((before, i))
            last[d, kind, key] = (start, i, before)
    return np.array(sorted(pairs), np.int64).reshape(-1, 2)


@dataclass
class Weights:
    shapes: np.ndarray  #: features by labels
    transitions: np.ndarray  #: labels by labels, log potentials of neighbours
    skip: float  #: added where tokens of a skip edge agree
    evidence: float  #: for the label of a base span
    rounds: int = 12


def _features(shape: np.ndarray) -> np.ndarray:
    return (shape[:, None] >> np.arange(SHAPES)) & 1


def situations(tokens: Tokens, hidden: np.ndarray) -> np.ndarray:
    """Of each token: shape, label, label of the evidence (0 where ``hidden``), labels of both neighbours (-1: none), and of up to two twins."""
    n = len(tokens.doc)
    doc, label = np.array(tokens.doc), np.array(tokens.label)
    out = np.full((n, 7), -1, np.int64)
    out[:, 0], out[:, 1], out[:, 2] = tokens.shape, label, np.where(hidden, 0, label)
    same = np.flatnonzero(doc[1:] == doc[:-1])
    out[same + 1, 3], out[same, 4] = label[same], label[same + 1]
    pairs = skip_edges(tokens)
    out[pairs[:, 1], 5], out[pairs[:, 0], 6] = label[pairs[:, 0]], label[pairs[:, 1]]
    return out


def fit(rows: np.ndarray, weight: np.ndarray, steps: int = 600, penalty: float = 1e-3) -> Weights:
    """Largest pseudo-likelihood of the labels of ``situations``, by gradient steps with a small penalty; the problem is convex."""
    n_labels = len(LABELS)
    x = _features(rows[:, 0]).astype(float)
    y, seen = np.eye(n_labels)[rows[:, 1]], np.eye(n_labels)[rows[:, 2]]
    seen[:, 0] = 0
    around = [np.where((rows[:, c] >= 0)[:, None], np.eye(n_labels)[np.maximum(rows[:, c], 0)], 0.0) for c in (3, 4, 5, 6)]
    twins = around[2] + around[3]
    scale = weight / max(weight.sum(), 1)
    w = [np.zeros((SHAPES, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(1), np.zeros(1)]
    sums = [np.full_like(v, 1e-8) for v in w]
    for _ in range(steps if len(rows) else 0):
        score = x @ w[0] + around[0] @ w[1] + around[1] @ w[1].T + w[2] * twins + w[3] * seen
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        miss = scale[:, None] * (y - p)
        slopes = [x.T @ miss, around[0].T @ miss + miss.T @ around[1], np.array([(miss * twins).sum()]), np.array([(miss * seen).sum()])]
        for v, total, slope in zip(w, sums, slopes, strict=True):
            slope = slope - penalty * v / max(np.sqrt(weight.sum()), 1)
            total += slope**2
            v += 0.5 * slope / np.sqrt(total)
    return Weights(w[0], w[1], float(max(w[2][0], 0)), float(max(w[3][0], 0)))


def learn(docs: DataFrame, text: str = "text", sample_rows: int = 20_000, hidden_share: float = 0.5) -> Weights:
    """Learn from the base spans of about ``sample_rows`` different texts at most, chosen by a hash. Counts of situations reach the driver."""
    bounded_batches(docs.sparkSession)
    rows = distinct_sample(docs.select(F.col(f"`{text}`").alias("text")), "text", sample_rows)
    names = [f"c{i}" for i in range(7)]

    def met(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part["text"].to_pylist()
        found = [base_spans(x) for x in texts]
        tokens = tokens_of(texts, [g for g, _ in found], [b for _, b in found])
        # all tokens of a span are hidden together, by a hash of its text and place
        hidden = np.array([s >= 0 and crc32(f"{s}:{texts[d][s : s + 40]}".encode()) % 1000 < 1000 * hidden_share for d, s in zip(tokens.doc, tokens.span, strict=True)], bool)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in situations(tokens, hidden).T], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_blocks(batches, lambda batch: batch["text"], met)

    counts = rows.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy(*names).count().orderBy(*names).toPandas().astype(np.int64)
    return fit(counts[names].to_numpy(), counts["count"].to_numpy())


def beliefs(tokens: Tokens, weights: Weights) -> np.ndarray:
    """Approximate marginals, tokens by labels, by loopy sum-product message passing."""
    n, n_labels = len(tokens.doc), len(LABELS)
    doc, label = np.array(tokens.doc), np.array(tokens.label)
    unary = _features(np.array(tokens.shape)) @ weights.shapes
    known = np.flatnonzero(label)
    unary[known, label[known]] += weights.evidence
    chain = np.flatnonzero(doc[1:] == doc[:-1])
    skip = skip_edges(tokens)
    source = np.concatenate([chain, skip[:, 0]])
    target = np.concatenate([chain + 1, skip[:, 1]])
    m = len(source)
    potential = np.concatenate([np.broadcast_to(weights.transitions, (len(chain), n_labels, n_labels)), np.broadcast_to(np.eye(n_labels) * weights.skip, (len(skip), n_labels, n_labels))])
    frm, to = np.concatenate([source, target]), np.concatenate([target, source])
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    message = np.zeros((2 * m, n_labels))
    twin = np.concatenate([np.arange(m, 2 * m), np.arange(m)])

    def gathered() -> np.ndarray:
        return unary + np.stack([np.bincount(to, message[:, k], minlength=n) for k in range(n_labels)], 1)

    for _ in range(weights.rounds if m else 0):
        into = gathered()[frm] - message[twin]
        scores = into[:, :, None] + potential
        top = scores.max(1)
        fresh = top + np.log(np.exp(scores - top[:, None, :]).sum(1))
        fresh -= fresh.max(1, keepdims=True)
        message = 0.5 * message + 0.5 * fresh
    total = gathered()
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(texts: list[str | None], spans: list, fails: list, weights: Weights, least: float = 0.5) -> list[list[tuple[str, int, int]]]:
    """Of each text, tokens outside all base spans that the field gives a label with more than ``least`` belief; neighbours of one kind are one span."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    tokens = tokens_of(texts, spans, fails)
    if not tokens.doc:
        return out
    p = beliefs(tokens, weights)
    best = p.argmax(1)
    for i in np.flatnonzero((best > 0) & (p.max(1) > least) & (np.array(tokens.label) == 0)):
        kind, d, start, end = LABELS[best[i]], tokens.doc[i], tokens.start[i], tokens.end[i]
        before = out[d][-1] if out[d] else None
        if before and before[0] == kind and 0 <= start - before[2] <= 2 and not texts[d][before[2] : start].strip(EDGE):
            out[d][-1] = (kind, before[1], end)
        else:
            out[d].append((kind, start, end))
    return out


def find(docs: DataFrame, weights: Weights, text: str = "text") -> DataFrame:
    """Columns row (struct of the input's columns), base and spans: arrays of (kind, start, end)."""
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def listed(spans: list) -> pa.Array:
        order = lambda x: (KINDS.index(x[0]), x[1])
        return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in sorted(own, key=order)] for own in spans], item)

    def found(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.struct_field(part["row"], text).to_pylist()
        both = [base_spans(x or "") for x in texts]
        base = [g for g, _ in both]
        more = added_spans(texts, base, [b for _, b in both], weights)
        return pa.RecordBatch.from_arrays([part["row"], listed(base), listed([a + b for a, b in zip(base, more, strict=True)])], ["row", "base", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_blocks(batches, lambda batch: pc.struct_field(batch["row"], text), found)

    bounded_batches(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, base {spans}, spans {spans}")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, learn(docs))
    spelt = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(spelt("base"), 256).alias("base_sha256"), spelt("spans").alias("spans"))
