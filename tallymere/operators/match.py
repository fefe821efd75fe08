"""Entity matching: exact keys, similar names, and the ordered merge of records into entities.

Records are merged in the order of ``ord``: each goes to the first entity that
matches it by identifier, symbol, or similar name with close dates, as that
entity stands when the record's turn comes.

Records are taken in turn by windows of a bounded number, each in one task, which gets the
entities that its records may meet; how entities stand goes from window to window as a table.
That is a guess of where every record went.  A round takes a guess, derives from it how each
entity stood at any time, and decides all records anew, by joins.  A guess that a round does
not change is the result of taking the records in turn, as each record's decision then rests
on right ones before it.  So the first round mostly only confirms; were the guess wrong
somewhere, a round makes at least the first undecided record of every chain right, so rounds end.

A key of an entity counts from the first member that came to it by another key: one
that came by this key alone can't have brought it.  Else records of one key, guessed
into a wrong entity, would each be held there by the next, and leave one in a round.

Similar names are found between blocks of distinct names of close lengths, a pair of blocks
a task.  Bounds drop most pairs before they are scored: characters that are not shared, as
bits that differ, first of whole runs of names that are alike, then of names; and characters
that match within the window, by bits.  None loses a pair.
"""

from __future__ import annotations

import itertools
import math
from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.names import company_key, premium_key, symbol_key
from ..functions.similarity import scores
from ..plans.scratch import Scratch

SAME, NEAR = 0.90, 0.85
DAYS = 30
PREMIUM = 0.92
BY_ISIN, BY_SYMBOL, BY_NAME = 1, 2, 4  #: by which keys a record found its entity, as a sum
WINDOW = 50_000  #: records that one task takes in turn
RECORD, PAIR, ENTITY = range(3)  #: what the rows of a window are
#: A record, a pair (id, name) of similar names, or an entity by its root; exchange is also whether an entity has a record of the exchange or the broker.
WINDOW_ROWS = {"kind": "int", "id": "long", "isin": "long", "sym": "long", "name": "long", "day": "int", "dated": "boolean", "exchange": "boolean", "broker": "boolean"}
TAKEN_ROWS = "kind int, id long, root long, by int, isin long, sym long, name long, day int, dated boolean, exchange boolean"
TAKEN = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in TAKEN_ROWS.split(", "))])


# --- similar names -----------------------------------------------------------------------------------------------


class _Side:
    """The distinct names of one block, by length, with what the bounds ask of them. Characters are numbered by an alphabet of both sides."""

    def __init__(self, texts: list[str], width: int):
        self.texts, self.n = texts, np.array([len(t) for t in texts])
        self.codes = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width)

    def number(self, alphabet: np.ndarray) -> None:
        self.kinds = np.where(np.arange(self.codes.shape[1]) < self.n[:, None], np.searchsorted(alphabet, self.codes), -1).astype(np.int16)
        row, column = np.nonzero(self.kinds >= 0)
        counts = np.bincount(row * len(alphabet) + self.kinds[row, column], minlength=len(self.texts) * len(alphabet))
        self.counts = counts.reshape(len(self.texts), len(alphabet)).astype(np.int32)

    def unary(self, most: np.ndarray) -> np.ndarray:
        """A column for each character and occurrence of it, so that a product of two sides counts shared characters."""
        return np.concatenate([self.counts[:, k, None] > np.arange(m) for k, m in enumerate(most)], 1).astype(np.float32)

    def mark(self, tokens: list[tuple[int, int]]) -> None:
        """Bits for characters and their occurrences, in words of 64, what is beyond four words folded into the last.

        Bits in which two texts differ are no more than the characters in which they do.
        """
        self.bits = np.zeros((min(4, math.ceil(len(tokens) / 64)), len(self.texts)), np.uint64)
        for t, (k, occurrence) in enumerate(tokens):
            self.bits[min(3, t // 64)] |= (self.counts[:, k] > occurrence).astype(np.uint64) << np.uint64(t % 64)

    @cached_property
    def places(self) -> np.ndarray:
        """Of each name and character the places that hold it, as bits. Of names of at most 64 characters."""
        out = np.zeros(self.counts.shape, np.uint64)
        for i in range(self.kinds.shape[1]):
            rows = np.nonzero(self.kinds[:, i] >= 0)[0]
            out[rows, self.kinds[rows, i]] |= np.uint64(1 << i)
        return out


def _prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows of codes, at most 4."""
    same = (a[..., :4] == b[..., :4]) & (a[..., :4] != 0)
    return np.logical_and.accumulate(same, -1).sum(-1)


class _Leaves:
    """The names of a side in runs of at most ``size`` that have one length, one beginning of ``head`` characters, and close bits in the first word.

    Runs come of halving: names of a length and beginning are parted by the bit that parts them most evenly, and each part by its own again.
    """

    def __init__(self, side: _Side, head: int, size: int = 16, together: int = 8):
        key = np.zeros(len(side.texts), np.int64)
        for k in range(head):
            key = key * 257 + side.kinds[:, k] + 1
        key = key * 128 + side.n
        order = np.argsort(key, kind="stable")
        bits = side.bits[0][order]
        first = np.nonzero(np.append(True, np.diff(key[order]) != 0))[0]
        while True:
            sizes = np.diff(np.append(first, len(order)))
            large = np.nonzero(sizes > size)[0]
            if not len(large):
                break
            # only names of runs that are still too large
            part = np.repeat(np.arange(len(large)), sizes[large])
            begun = np.cumsum(sizes[large]) - sizes[large]
            at = np.arange(len(part)) - begun[part] + first[large][part]
            held = np.stack([np.add.reduceat(bits[at] >> np.uint64(k) & np.uint64(1), begun) for k in range(64)], 1).astype(np.int64)
            uneven = np.abs(2 * held - sizes[large][:, None])
            chosen = uneven.argmin(1)
            # alike in all bits: parted in the middle
            alike = uneven[np.arange(len(large)), chosen] == sizes[large]
            value = np.where(alike[part], at - first[large][part] >= size, bits[at] >> chosen.astype(np.uint64)[part] & np.uint64(1))
            moved = at[np.argsort(part * 2 + value.astype(np.int64), kind="stable")]
            order[at], bits[at] = order[moved], bits[moved]
            zeros = np.where(alike, size, sizes[large] - held[np.arange(len(large)), chosen])
            first = np.sort(np.concatenate([first, first[large] + zeros]))
        rows, there = self._runs(first, len(order), size)
        rows = order[rows]
        self.rows, self.bits = np.where(there, rows, -1), side.bits[0][rows]
        self.every, self.some = np.bitwise_and.reduce(self.bits, 1), np.bitwise_or.reduce(self.bits, 1)
        # runs of one length and beginning, some together
        key, at = key[order[first]], np.arange(len(first))
        begun = np.maximum.accumulate(np.where(np.append(True, np.diff(key) != 0), at, 0))
        group = np.nonzero((at - begun) % together == 0)[0]
        rows, there = self._runs(group, len(first), together)
        self.leaves, self.key, self.n = np.where(there, rows, -1), key[group], side.n[order[first[group]]]
        self.all_every, self.all_some = np.bitwise_and.reduce(self.every[rows], 1), np.bitwise_or.reduce(self.some[rows], 1)

    @staticmethod
    def _runs(first: np.ndarray, end: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of runs that begin at ``first``, and which there are; a shorter run repeats its first place."""
        places = first[:, None] + np.arange(size)
        there = places < np.append(first[1:], end)[:, None]
        return np.where(there, places, first[:, None]), there


def _limits(least: float) -> np.ndarray:
    """What shared characters by the size of either text must add up to, by the length of the common prefix: a score takes shared / size + shared / other size >= 3 jaro - 1."""
    return np.array([3 * (least - 0.1 * p) / (1 - 0.1 * p) - 1 - 1e-6 for p in range(5)])


def _spare(limit: float) -> np.ndarray:
    """Of two lengths up to 64, how many characters of the first need not be shared; -1 if none of such lengths can meet the limit."""
    n = np.arange(65)
    shared = np.maximum(np.ceil(limit / (1 / np.maximum(n[:, None], 1) + 1 / np.maximum(n, 1))), 0)
    return np.where((shared <= np.minimum(n[:, None], n)) & (n > 0) & (n[:, None] > 0), n[:, None] - shared, -1).astype(np.int16)


def _close_leaves(left: _Leaves, right: _Leaves, p: np.ndarray, q: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of groups of runs, the pairs of runs whose bits allow what is to spare, and how many bits of them may differ."""
    u, v = left.leaves[p], right.leaves[q]
    here, there = spare[left.n[p], right.n[q]].astype(np.uint8), spare[right.n[q], left.n[p]].astype(np.uint8)
    met = np.bitwise_count(left.every[u][:, :, None] & ~right.some[v][:, None, :]) <= here[:, None, None]
    met &= np.bitwise_count(right.every[v][:, None, :] & ~left.some[u][:, :, None]) <= there[:, None, None]
    met &= (u >= 0)[:, :, None] & (v >= 0)[:, None, :]
    of, i, j = np.nonzero(met)
    return u[of, i], v[of, j], here[of] + there[of]


def _close_pairs(a: _Side, b: _Side, head: int, limit: float, chunk: int = 1 << 16, batch: int = 50_000) -> Iterator[list[np.ndarray]]:
    """Pairs that begin alike in ``head`` characters and whose bits in the first word allow ``limit``, with the number of bits that differ, in batches. Runs meet before names do."""
    kept, n = [], 0
    spare = _spare(limit)
    able, apart = spare >= 0, spare + spare.T
    left, right = _Leaves(a, head), _Leaves(b, head)
    lowest, highest = able.argmax(1), 64 - able[:, ::-1].argmax(1)
    start = np.searchsorted(right.key, left.key - left.n + lowest[left.n])
    count = np.searchsorted(right.key, left.key - left.n + highest[left.n], "right") - start
    size, ends = left.rows.shape[1], np.cumsum(count)
    lo = 0
    while lo < len(count):
        before = ends[lo] - count[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, before + chunk, "right")))
        p = np.repeat(np.arange(lo, hi), count[lo:hi])
        q = np.arange(len(p)) - np.repeat(ends[lo:hi] - count[lo:hi] - before, count[lo:hi]) + start[p]
        lo = hi
        for one, other, allowed in ((left, right, spare), (right, left, spare.T)):
            u, v = (p, q) if one is left else (q, p)
            met = np.bitwise_count(one.all_every[u] & ~other.all_some[v]) <= allowed[left.n[p], right.n[q]]
            p, q = p[met], q[met]
        if not len(p):
            continue
        near = [_close_leaves(left, right, p[part : part + 4096], q[part : part + 4096], spare) for part in range(0, len(p), 4096)]
        p, q, most = (np.concatenate(k) for k in zip(*near, strict=True))
        for part in range(0, len(p), 1024):
            u, v = p[part : part + 1024], q[part : part + 1024]
            differ = np.bitwise_count(left.bits[u][:, :, None] ^ right.bits[v][:, None, :])
            at = np.flatnonzero(differ <= most[part : part + 1024, None, None])
            of, rest = np.divmod(at, size * size)
            i, j = left.rows[u[of], rest // size], right.rows[v[of], rest % size]
            there = (i >= 0) & (j >= 0)
            kept.append((i[there], j[there], differ.reshape(-1)[at[there]]))
            n += len(kept[-1][0])
            if n >= batch:
                yield [np.concatenate(k) for k in zip(*kept, strict=True)]
                kept, n = [], 0
    if n:
        yield [np.concatenate(k) for k in zip(*kept, strict=True)]


def _shared_pairs(a: _Side, b: _Side, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs whose shared characters and common prefix allow a score of ``least``, in batches; each once, loses none. Of names of at most 64 characters.

    The longer the common prefix, the more characters may differ, and the fewer names have it: names of no common prefix, of one or two characters, and of more
    are found each by a limit of their own.
    """
    limits = _limits(least)
    spare = np.stack([_spare(limit) for limit in limits])
    most = np.maximum(a.counts.max(0), b.counts.max(0))
    tokens = [(k, o) for k, m in enumerate(most) for o in range(m)]
    held = np.array([(b.counts[:, k] > o).mean() for k, o in tokens])
    tokens = [tokens[t] for t in np.argsort(np.abs(held - 0.5), kind="stable")]
    for side in (a, b):
        side.mark(tokens)
    for head, prefixes in ((0, (0,)), (1, (1, 2)), (3, (3, 4))):
        for i, j, differ in _close_pairs(a, b, head, limits[prefixes[-1]]):
            prefix = _prefix(a.codes[i], b.codes[j])
            own = (prefix >= prefixes[0]) & (prefix <= prefixes[-1])
            i, j, prefix, differ = i[own], j[own], prefix[own], differ[own].astype(np.int16)
            for one, other in zip(a.bits[1:], b.bits[1:], strict=True):
                differ += np.bitwise_count(one[i] ^ other[j])
            own = (spare[prefix, a.n[i], b.n[j]] >= 0) & (differ <= spare[prefix, a.n[i], b.n[j]] + spare[prefix, b.n[j], a.n[i]])
            yield i[own], j[own]


def _matched(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of places (i, j), i by falling length, the matched characters of either text, as bits."""
    n, window = a.n[i], np.maximum(a.n[i], b.n[j]) // 2 - 1
    taken, used, one = np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64), np.uint64(1)
    near = np.array([(1 << k) - 1 for k in range(65)], np.uint64)[np.minimum(window + 1, 64)]
    held, rising = a.kinds[i], -n
    for k in range(int(n.max(initial=0))):
        m = np.searchsorted(rising, -k)  # texts longer than k
        free = b.places[j[:m], held[:m, k]] & near[:m] & ~used[:m]
        used[:m] |= free & (~free + one)
        taken[:m] |= (free != 0).astype(np.uint64) << np.uint64(k)
        near = (near << one) | (k < window).astype(np.uint64)
    return taken, used


def _exact(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, taken: np.ndarray, used: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Scores from matched characters, in the steps of functions.similarity, so the numbers are the same. Those below ``least`` can be given as 0: a pair goes no further than the characters out of order that it may have."""
    one = np.uint64(1)
    m, moved = np.bitwise_count(taken).astype(np.int64), np.zeros(len(i), np.int64)
    prefix = _prefix(a.codes[i], b.codes[j])
    jaro = (least - 0.1 * prefix) / (1 - 0.1 * prefix)
    most = 2 * m * (m / a.n[i] + m / b.n[j] + 1 - 3 * jaro) + 1e-6
    rest = np.nonzero(taken)[0]
    left, right = taken[rest], used[rest]
    while len(rest):
        at = [np.bitwise_count((bits & (~bits + one)) - one) for bits in (left, right)]
        moved[rest] += a.codes[i[rest], at[0]] != b.codes[j[rest], at[1]]
        left, right = left & (left - one), right & (right - one)
        more = (left != 0) & (moved[rest] <= most[rest])
        left, right, rest = left[more], right[more], rest[more]
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / a.n[i] + m / b.n[j] + (m - moved / 2) / m) / 3
    out = np.where((m == 0) | (moved > most), 0.0, jaro + prefix * 0.1 * (1 - jaro))
    same = np.nonzero((a.n[i] == b.n[j]) & (m == a.n[i]) & (moved == 0) | (a.n[i] == 1) & (b.n[j] == 1))[0]
    out[same[(a.codes[i[same]] == b.codes[j[same]]).all(1)]] = 1.0
    return out


def _long_pairs(x: list[str], y: list[str], least: float, both: bool, rows: int = 500) -> Iterator[tuple[list[str], list[str], np.ndarray, np.ndarray | None]]:
    """scored_pairs of texts of any length and characters: some of either side at a time, by products that count shared characters, then scored in columns."""
    limits = _limits(least) - 1e-4
    ratio = max(limits.min() - 1, 1e-9)
    x, y = sorted(x, key=len), sorted(y, key=len)
    sizes = np.array([len(t) for t in y])
    for lo in range(0, len(x), rows):
        own = x[lo : lo + rows]
        c, d = np.searchsorted(sizes, len(own[0]) * ratio - 1e-6), np.searchsorted(sizes, len(own[-1]) / ratio + 1e-6, "right")
        for at in range(c, d, rows):
            others = y[at : min(at + rows, d)]
            width = max(4, len(own[-1]), len(others[-1]))
            a, b = _Side(own, width), _Side(others, width)
            alphabet = np.union1d(a.codes, b.codes)
            for side in (a, b):
                side.number(alphabet)
            most = np.minimum(a.counts.max(0), b.counts.max(0))
            share = (a.unary(most) @ b.unary(most).T) * (1 / a.n[:, None] + 1 / b.n)
            i, j = np.nonzero(share >= limits.min())
            kept = share[i, j] >= limits[_prefix(a.codes[i], b.codes[j])]
            i, j = i[kept], j[kept]
            step = max(1, 1_000_000 // width)
            for k in range(0, len(i), step):
                left, right = [own[t] for t in i[k : k + step]], [others[t] for t in j[k : k + step]]
                yield left, right, scores(right, left), scores(left, right) if both else None


def scored_pairs(x: list[str], y: list[str], least: float, both: bool, chunk: int = 20_000, rising: bool = False) -> tuple[list[str], list[str], np.ndarray, np.ndarray | None]:
    """Pairs of two lists of non-empty texts with the scores of (y, x), and if ``both`` of (x, y) too, of which one is at least ``least``; loses none.

    Characters that match within the window are as many in both directions, as those of a kind are taken first to first; so the first
    direction's number bounds both, whatever the order of the characters.  ``rising``: instead, the score in one direction, from the lesser to the greater text, and
    the texts in that order; equal texts are no pair, and if the lists are the same, a pair stands once.  Texts of more than 64 characters, or beyond 256 kinds of them, have no bits and go by products and columns.
    """
    kinds = set("".join(itertools.chain(x, y)))
    if len(kinds) > 256:
        kinds = {c for c, _ in Counter(itertools.chain.from_iterable(itertools.chain(x, y))).most_common(256)}
    short, long = ([[t for t in side if (len(t) <= 64 and kinds.issuperset(t)) == fits] for side in (x, y)] for fits in (True, False))
    long_texts, same = set(long[0]), rising and x == y
    found = [_short_pairs(*short, least, both, chunk, rising, same)] if all(short) else []
    for of, others in ((long[0], y), (short[0], long[1])):
        if same and of is not long[0]:
            continue  # these stand among the pairs of long texts with all
        for left, right, back, there in _long_pairs(of, others, least, both or rising):
            if rising:
                kept = [k for k, (p, q) in enumerate(zip(left, right, strict=True)) if (there[k] if p < q else back[k]) >= least and p != q and not (same and p > q and q in long_texts)]
                pairs = [(left[k], right[k], there[k]) if left[k] < right[k] else (right[k], left[k], back[k]) for k in kept]
                found.append(([p for p, _, _ in pairs], [q for _, q, _ in pairs], np.array([s for _, _, s in pairs], float), None))
                continue
            kept = np.nonzero((back if there is None else np.maximum(back, there)) >= least)[0]
            found.append(([left[k] for k in kept], [right[k] for k in kept], back[kept], None if there is None else there[kept]))
    none = np.zeros(0)
    left, right = ([t for f in found for t in f[k]] for k in range(2))
    return left, right, np.concatenate([none, *(f[2] for f in found)]), np.concatenate([none, *(f[3] for f in found)]) if both else None


def _short_pairs(x: list[str], y: list[str], least: float, both: bool, chunk: int, rising: bool = False, same: bool = False) -> tuple[list[str], list[str], np.ndarray, np.ndarray | None]:
    """scored_pairs of texts of at most 64 characters, of at most 256 kinds."""
    width = max(4, *map(len, x), *map(len, y))
    a, b = _Side(sorted(x, key=len), width), _Side(sorted(y, key=len), width)
    alphabet = np.union1d(a.codes, b.codes)
    for side in (a, b):
        side.number(alphabet)
    none = np.zeros(0, np.int64), np.zeros(0)

    def scored(one: _Side, other: _Side, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that may reach ``least`` by their matched characters, and their scores from ``one`` to ``other``, 0 for some below it."""
        order = np.argsort(-one.n[i], kind="stable")
        i, j = i[order], j[order]
        taken, used = _matched(one, other, i, j)
        count = np.bitwise_count(taken).astype(np.float64)
        jaro = np.where(count > 0, (count / one.n[i] + count / other.n[j] + 1) / 3, 0)
        # texts of one character match nothing within the window, yet equal ones score 1
        kept = (jaro + 0.1 * _prefix(one.codes[i], other.codes[j]) * (1 - jaro) >= least - 1e-9) | ((one.n[i] == 1) & (other.n[j] == 1))
        i, j = i[kept], j[kept]
        return i, j, _exact(one, other, i, j, taken[kept], used[kept], least)

    if rising:
        at = {t: k for k, t in enumerate(sorted({*x, *y}))}
        ranks = [np.array([at[t] for t in side.texts]) for side in (a, b)]
        left, right, found = [], [], [none[1]]
        for i, j in _shared_pairs(a, b, least):
            lesser, greater = ranks[0][i] < ranks[1][j], ranks[0][i] > ranks[1][j]
            for (one, other), p, q in (((a, b), i[lesser], j[lesser]), *([] if same else [((b, a), j[greater], i[greater])])):
                for lo in range(0, len(p), chunk):
                    u, v, score = scored(one, other, p[lo : lo + chunk], q[lo : lo + chunk], least)
                    kept = np.nonzero(score >= least)[0]
                    left += [one.texts[k] for k in u[kept]]
                    right += [other.texts[k] for k in v[kept]]
                    found.append(score[kept])
        return left, right, np.concatenate(found), None
    out = [(none[0], none[0], none[1], none[1])]
    for i, j in _shared_pairs(a, b, least):
        for lo in range(0, len(i), chunk):
            q, p, back = scored(b, a, j[lo : lo + chunk], i[lo : lo + chunk], least)
            there = None
            if both:
                order = np.argsort(-a.n[p], kind="stable")
                p, q, back = p[order], q[order], back[order]
                there = _exact(a, b, p, q, *_matched(a, b, p, q), least)
            kept = np.nonzero((back if there is None else np.maximum(back, there)) >= least)[0]
            p, q, back = p[kept], q[kept], back[kept]
            if both:
                # what is below the bound in one direction alone counts as it is, too
                there = there[kept]
                for one, other, u, v, score in ((b, a, q, p, back), (a, b, p, q, there)):
                    low = np.nonzero(score < least)[0]
                    low = low[np.argsort(-one.n[u[low]], kind="stable")]
                    score[low] = _exact(one, other, u[low], v[low], *_matched(one, other, u[low], v[low]))
            out.append((p, q, back, there))
    i, j, back = (np.concatenate([o[k] for o in out]) for k in range(3))
    return [a.texts[k] for k in i], [b.texts[k] for k in j], back, np.concatenate([o[3] for o in out]) if both else None


def _met(left: DataFrame, right: DataFrame, least: float, both: bool, groups: int, best: bool = False, rising: bool = False) -> DataFrame:
    """Pairs x, y with score of two dealt sides (i, j, x) and (i, j, y). ``both``: of one set of names dealt as both sides, each pair in both directions.

    ``best``: of a group's pairs, those with the highest score of their x.  ``rising``: of one set dealt so, each pair once, x before y.
    """

    def pairs(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = sorted(a["x"].to_pylist()), sorted(b["y"].to_pylist())
        if not x or not y:
            return pa.table({"x": pa.array([], pa.string()), "y": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        left, right, back, there = scored_pairs(x, y, least, both, rising=rising)
        # in one set the score is that of (x, y), between two sets that of (y, x)
        found = [(left, right, there), (right, left, back)] if both else [(left, right, back)]
        found = [pa.table({"x": pa.array(p, pa.string()), "y": pa.array(q, pa.string()), "score": r}).filter(pa.array(r >= least)) for p, q, r in found]
        if both and key[0].as_py() == key[1].as_py():  # both directions stand in either half
            found = [t.filter(pc.not_equal(t["x"], t["y"])) for t in found[:1]]
        out = pa.concat_tables(found)
        if best:
            codes = out["x"].combine_chunks().dictionary_encode().indices.to_numpy()
            highest = np.zeros(len(x))
            np.maximum.at(highest, codes, out["score"].to_numpy())
            out = out.filter(pa.array(out["score"].to_numpy() == highest[codes]))
        return out

    # few rows and much work: as many partitions as pairs of blocks, which are not put together for their size
    dealt = [side.repartition(min(groups, 10_000), "i", "j").groupBy("i", "j") for side in (left, right)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(pairs, "x string, y string, score double")


@dataclass
class _Blocks:
    """Names dealt into blocks of close lengths; lengths with more names than a block have several."""

    names: DataFrame  #: name, b
    bands: list[tuple[int, int, int]]  #: least length, first block and number of blocks, by rising length
    total: int

    def between(self, other: _Blocks, least: float) -> list[tuple[int, int]]:
        """By band, the first and the last block of the other side whose lengths allow a score of ``least``."""
        # shorter over longer size is at least this
        ratio = max(_limits(least).min() - 1, 0)
        ends = lambda bands: [*(b[0] - 1 for b in bands[1:]), math.inf]
        out = []
        for (low, _, _), high in zip(self.bands, ends(self.bands), strict=True):
            near = [(first, first + n - 1) for (start, first, n), end in zip(other.bands, ends(other.bands), strict=True) if end >= low * ratio and high >= start * ratio]
            out.append((near[0][0], near[-1][1]) if near else (0, -1))
        return out

    def of_band(self, values: list[int]) -> Column:
        """The value of a name's band, by its block."""
        out = F.lit(values[0])
        for (_, first, _), value in zip(self.bands, values, strict=True):
            out = F.when(F.col("b") >= first, F.lit(value)).otherwise(out)
        return out


def _blocks(names: DataFrame, block: int | None, most: int) -> _Blocks:
    """Blocks of at most about ``block`` names; by default an eighth of all, so that there are pairs of blocks for many tasks, from 500 to ``most``."""
    size = F.least(F.length("name"), F.lit(65))
    counts = sorted(tuple(r) for r in names.groupBy(size.alias("n")).count().collect())
    block = block or min(most, max(500, sum(c for _, c in counts) // 8))
    bands, total, room = [], 0, 0
    for n, count in counts:
        if bands and count <= room:
            room -= count
            continue
        parts = math.ceil(count / block)
        bands.append((n, total, parts))
        total += parts
        room = block - count if parts == 1 else 0
    place = F.lit(0)
    for n, first, parts in bands:
        place = F.when(size >= n, F.lit(first) + F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int")).otherwise(place)
    return _Blocks(names.select("name", place.alias("b")), bands or [(0, 0, 1)], max(total, 1))


def similar_names(names: DataFrame, scratch: Scratch, least: float = NEAR, block: int | None = None, rising: bool = False) -> DataFrame:
    """Of distinct non-empty names (column name), pairs x, y with score of (x, y) at least ``least``, in both directions, or if ``rising`` those with x before y.

    Names are dealt into blocks by length, and each pair of blocks whose lengths allow it is one group of at most two blocks.
    """
    names = scratch.save(names.select("name"), "names")
    dealt = _blocks(names, block, 20_000)
    near = dealt.between(dealt, least)
    first, last = (dealt.of_band([ends[k] for ends in near]) for k in range(2))
    left = dealt.names.select("name", "b", F.explode(F.sequence(F.col("b"), last)).alias("other")).select(F.col("b").alias("i"), F.col("other").alias("j"), F.col("name").alias("x"))
    right = dealt.names.select(F.explode(F.sequence(first, F.col("b"))).alias("i"), F.col("b").alias("j"), F.col("name").alias("y"))
    met = scratch.save(_met(left, right, least, not rising, dealt.total * (dealt.total + 1) // 2, rising=rising), "similar-names")
    scratch.drop("names")
    return met


def names_between(names: DataFrame, others: DataFrame, least: float, block: int | None = None, best: bool = False) -> DataFrame:
    """Of two sets of distinct non-empty names (column name), pairs x, y with score of (y, x) at least ``least``; a block of each side is one group.

    ``best``: not all such pairs; those with the highest score of their x are among them.
    """
    ours, theirs = _blocks(names, block, 60_000), _blocks(others, block, 60_000)

    def met(one: _Blocks, other: _Blocks) -> Column:
        near = one.between(other, least)
        first, last = (one.of_band([ends[k] for ends in near]) for k in range(2))
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    left = ours.names.select(F.col("b").alias("i"), met(ours, theirs).alias("j"), F.col("name").alias("x"))
    right = theirs.names.select(met(theirs, ours).alias("i"), F.col("b").alias("j"), F.col("name").alias("y"))
    return _met(left, right, least, False, ours.total * theirs.total, best)


# --- ordered merge -----------------------------------------------------------------------------------------------


@dataclass
class Merge:
    masters: DataFrame  #: the entities: first_ord, n_members, and the columns of a record
    members: DataFrame  #: ord of each record, with the first_ord of its entity
    find_misses: Callable[[], DataFrame]

    @cached_property
    def misses(self) -> DataFrame:
        """Near misses: reason, score, first_ord of the entity, ord of the record, and both as they stood (existing, incoming)."""
        return self.find_misses()


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _keyed(records: DataFrame) -> DataFrame:
    return records.withColumns({
        "name": company_key(F.col("company_name")), "sym": symbol_key(F.col("symbol")),
        "day": F.datediff(parse_date(F.col("bidding_start_date")), F.lit("1970-01-01").cast("date")),
    })


def _standing(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How entities stood, from their members (root, ord, by, and keys), without those whose root is no entity: keys with the order at which each was set, and dates (root, since, until, start, day).

    Isin, symbol and name are those of the first member that has one and did not come by it alone.  The
    start is that of the last member from the exchange that has one, else of
    the first one from the broker if none from either came before, else the
    first there is.
    """
    brings = lambda name, key: _filled(name) & ((F.col("ord") == F.col("root")) | (F.col("by") != key))
    first = lambda test, *columns: F.min(F.when(test, F.struct("ord", *columns)))
    keys = members.groupBy("root").agg(
        first(brings("isin", BY_ISIN), "isin").alias("by_isin"), first(brings("symbol", BY_SYMBOL), "sym", "symbol").alias("by_sym"),
        first(brings("company_name", BY_NAME), "name", "company_name").alias("by_name"), F.min("ord").alias("least"),
    ).where("least = root").drop("least")
    turn = Window.partitionBy("root").orderBy("ord")
    before = F.coalesce(F.max(F.col("src").isin("nse", "upstox")).over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    overrules = _filled("bidding_start_date") & ((F.col("src") == "nse") | ((F.col("src") == "upstox") & ~before))
    own = F.struct(F.col("bidding_start_date").alias("start"), "day")
    now = F.coalesce(F.last(F.when(overrules, own), True).over(turn), F.first(F.when(_filled("bidding_start_date"), own), True).over(turn))
    least = F.min("ord").over(Window.partitionBy("root"))
    dates = members.select("root", F.col("ord").alias("since"), now.alias("now"), least.alias("least")).where("least = root").drop("least")
    turn = Window.partitionBy("root").orderBy("since")
    dates = dates.withColumn("was", F.lag("now").over(turn)).where(~F.col("now").eqNullSafe(F.col("was")))
    return keys, dates.select("root", "since", F.lead("since").over(turn).alias("until"), "now.start", "now.day")


def _steps(entities: DataFrame) -> DataFrame:
    """Of entities (key, value, at, root) that hold a key's value from ``at`` on: the least root that an order finds, as key, value, root, from_, to: orders above from_ and up to to.

    A value has as many rows as its least root has values in time, mostly one, however many records share it.
    """
    turn = Window.partitionBy("key", "value").orderBy("at")
    lower = entities.withColumn("lowest", F.min("root").over(turn.rowsBetween(Window.unboundedPreceding, -1))).where("lowest is null or root < lowest")
    return lower.select("key", "value", "root", F.col("at").alias("from_"), F.lead("at").over(turn).alias("to"))


def _found_by_name(wanted: DataFrame, keys: DataFrame, dates: DataFrame) -> DataFrame:
    """Columns ord, root: of what records want (ord, y, on), entities of that name whose date, as it stood at the record's turn, is close.

    Records meet entities whose dates ever fall near theirs, by name and month; how an entity then stood is the last of its dates before the record, in
    one pass over both, so the changes of an entity's date are not multiplied with the records that ask for it.
    """
    month = lambda day: F.floor(F.col(day) / (DAYS + 1))
    months = dates.where("day is not null").groupBy("root").agg(F.collect_set(month("day")).alias("months"))
    near = keys.where("by_name.name <> ''").join(months, "root").select("root", F.col("by_name.name").alias("y"), F.col("by_name.ord").alias("at"), F.explode("months").alias("month"))
    asks = wanted.withColumn("month", F.explode(F.array(month("on") - 1, month("on"), month("on") + 1)))
    asks = asks.join(near, ["y", "month"]).where("root < ord and at < ord")
    both = asks.select("root", "ord", F.lit(0).alias("kind"), "on", F.lit(None).cast("struct<day:int>").alias("now"))
    both = both.union(dates.select("root", "since", F.lit(1), F.lit(None).cast("int"), F.struct("day")))
    now = F.last("now", True).over(Window.partitionBy("root").orderBy("ord", "kind"))
    return both.withColumn("now", now).where((F.col("kind") == 0) & (F.abs(F.col("now.day") - F.col("on")) <= DAYS)).select("ord", "root")


def _by_key(frame: DataFrame, isin: Column, symbol: Column, *more: str) -> DataFrame:
    """Rows of key and value for the isin and the symbol, each a struct with a value, with columns of the frame."""
    with_key = lambda c, key: F.struct(F.lit(key).alias("key"), c["value"].alias("value"), c["at"].alias("at"))
    return frame.select(*more, F.explode(F.array(with_key(isin, BY_ISIN), with_key(symbol, BY_SYMBOL))).alias("k")).where("k.value <> ''").select(*more, "k.*")


def _decided(guess: DataFrame, wanted: DataFrame) -> DataFrame:
    """One round: the keys of records with a new root (the record's entity, by its first order), by, and moved, from those with a guess of root and by."""
    keys, dates = _standing(guess)
    held = lambda of, name: F.struct(F.col(f"{of}.{name}").alias("value"), F.col(f"{of}.ord").alias("at"))
    own = lambda name: F.struct(F.col(name).alias("value"), F.col("ord").alias("at"))
    steps = _steps(_by_key(keys, held("by_isin", "isin"), held("by_sym", "sym"), "root"))
    met = _by_key(guess, own("isin"), own("sym")).withColumnRenamed("at", "ord").join(steps, ["key", "value"])
    found = met.where((F.col("from_") < F.col("ord")) & (F.col("to").isNull() | (F.col("ord") <= F.col("to")))).select("ord", "root", "key")
    found = found.union(_found_by_name(wanted, keys, dates.select("root", "since", "day")).select("ord", "root", F.lit(BY_NAME)))
    kinds = (BY_ISIN, BY_SYMBOL, BY_NAME)
    best = found.groupBy("ord").agg(F.min("root").alias("best"), *[F.min(F.when(F.col("key") == k, F.col("root"))).alias(f"best_{k}") for k in kinds])
    by = sum((F.when(F.col(f"best_{k}") == F.col("best"), k).otherwise(0) for k in kinds), F.lit(0))
    now = F.coalesce("best", "ord")
    met = guess.join(best, "ord", "left").withColumns({"moved": (now != F.col("root")) | (by != F.col("by")), "root": now, "by": by})
    return met.drop("best", *[f"best_{k}" for k in kinds])


def _taken(rows: pa.Table) -> pa.Table:
    """Records of a window, taken in turn: the root and by of each, and the entities that they make or change, as they stand after it.

    The table has the records, the pairs of similar names and the entities from before the window that they may meet, by kind, as ``_in_turn`` makes it.
    """
    of = lambda kind, *columns: zip(*(rows.filter(pc.equal(rows["kind"], kind))[c].to_pylist() for c in columns), strict=True)
    similar = defaultdict(list)
    for x, y in of(PAIR, "id", "name"):
        similar[x].append(y)
    entities, by_isin, by_sym, by_name, taken, touched = {}, {}, {}, defaultdict(list), [], set()

    def hold(root: int, isin: int | None, sym: int | None) -> None:
        for held, value in ((by_isin, isin), (by_sym, sym)):
            if value:
                held[value] = min(root, held.get(value, root))

    for root, isin, sym, *rest in sorted(of(ENTITY, "id", "isin", "sym", "name", "day", "dated", "exchange")):
        entities[root] = [isin, sym, *rest]
        hold(root, isin, sym)
        if rest[0] and rest[1] is not None:
            by_name[rest[0]].append(root)

    def near(name: int, day: int) -> int | None:
        best = None
        for y in (name, *similar.get(name, ())):
            for root in by_name.get(y, ()):
                if best is not None and root >= best:
                    break
                held = entities[root][3]
                if held is not None and abs(held - day) <= DAYS:
                    best = root
        return best

    for ord_, isin, sym, name, day, dated, exchange, broker in sorted(of(RECORD, "id", "isin", "sym", "name", "day", "dated", "exchange", "broker")):
        found = (by_isin.get(isin), by_sym.get(sym), near(name, day) if name and day is not None else None)
        root = min((f for f in found if f is not None), default=ord_)
        taken.append((ord_, root, sum(key for key, f in zip((BY_ISIN, BY_SYMBOL, BY_NAME), found, strict=True) if f == root)))
        touched.add(root)
        e = entities.setdefault(root, [None, None, None, None, False, False])
        unnamed = not e[2] or e[3] is None
        e[:3] = [value if own is None else own for own, value in zip(e, (isin, sym, name))]
        hold(root, e[0], e[1])
        if dated and (exchange or not e[4] or (broker and not e[5])):
            e[3], e[4] = day, True
        e[5] = e[5] or exchange or broker
        if unnamed and e[2] and e[3] is not None and root not in by_name[e[2]]:
            insort(by_name[e[2]], root)
    none = [None] * len(taken)
    out = [[RECORD] * len(taken), *map(list, zip(*taken, strict=True)), *[none] * 6] if taken else [[]] * 10
    more = [(ENTITY, root, None, None, *entities[root]) for root in sorted(touched)]
    return pa.table([pa.array([*a, *b], t) for a, b, t in zip(out, zip(*more, strict=True) if more else out, TAKEN.types, strict=True)], TAKEN)


def _in_turn(light: DataFrame, asks: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """Columns ord, root, by: records taken in turn, by windows of about ``window`` of them; asks are pairs (x, y) of different similar names.

    A window is one task's, which reads no more than its records, the pairs of their names, and of the entities from before it those that its keys and names lead to; how
    entities stand goes from window to window as a table.  Keys and names are numbers there, by a hash: two that clashed would make a wrong guess, which rounds put right.
    """
    spark = light.sparkSession
    number = lambda c: F.when(F.col(c) != "", F.xxhash64(c)).otherwise(F.lit(0))
    known = lambda test, c: F.when(_filled(test), number(c))
    ids = light.select(
        F.col("ord").alias("id"), known("isin", "isin").alias("isin"), known("symbol", "sym").alias("sym"), known("company_name", "name").alias("name"), "day",
        _filled("bidding_start_date").alias("dated"), (F.col("src") == "nse").alias("exchange"), (F.col("src") == "upstox").alias("broker"),
    )
    ids = scratch.save(ids, "numbers")
    asks = scratch.save(asks.select(F.xxhash64("x").alias("id"), F.xxhash64("y").alias("name")), "near-numbers")
    parts = math.ceil(ids.count() / window)
    cuts = ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 100_000)).first()[0] if parts > 1 else []
    columns = ["kind", *ids.columns]
    rows = lambda frame, kind: frame.withColumn("kind", F.lit(kind)).select(*[c if c in (*frame.columns, "kind") else F.lit(None).cast(t).alias(c) for c, t in WINDOW_ROWS.items()])
    ends, state = [*sorted(set(cuts)), None], None
    for k, end in enumerate(ends):
        own = ids if end is None else ids.where(F.col("id") <= end)
        own = own if k == 0 else own.where(F.col("id") > ends[k - 1])
        names = own.where("name <> 0 and day is not null").select("name").distinct()
        near = asks.join(names.withColumnRenamed("name", "id"), "id", "left_semi")
        given = rows(own, RECORD).union(rows(near, PAIR))
        if state is not None:
            by = lambda c: state.where(f"{c} <> 0").join(own.select(c).distinct(), c, "left_semi").groupBy(c).agg(F.min("id").alias("id")).select("id")  # noqa: B023, E731
            named = state.where("name <> 0 and day is not null").join(names.union(near.select("name")).distinct(), "name", "left_semi").select("id")
            given = given.union(rows(state.join(by("isin").union(by("sym")).union(named).distinct(), "id"), ENTITY))
        turn = scratch.save(given.select(*columns).groupBy().applyInArrow(_taken, TAKEN_ROWS), f"turn-{k}")
        if end is not None:
            changed = turn.where(F.col("kind") == ENTITY).select("id", "isin", "sym", "name", "day", "dated", "exchange")
            state = scratch.save(changed if state is None else state.join(changed, "id", "left_anti").union(changed), f"state-{k}")
            if k:
                scratch.drop(f"state-{k - 1}")
    taken = spark.read.schema(TAKEN_ROWS).parquet(*[f"{scratch.path}/turn-{k}" for k in range(len(ends))])
    return taken.where(F.col("kind") == RECORD).select(F.col("id").alias("ord"), "root", "by")


def _merged(members: DataFrame) -> DataFrame:
    """Entities of their members, with precedence of sources for dates, bands and documents."""
    whole = Window.partitionBy("root")
    at = lambda test, most=F.min: most(F.when(test, F.col("ord"))).over(whole)
    has_band, has_low = F.col("price_band").isNotNull(), F.col("price_band.minimum").isNotNull()
    nse = F.col("src") == "nse"
    rows = members.withColumn("_broker", at(F.col("src") == "upstox"))
    early = F.col("_broker").isNull() | (F.col("ord") < F.col("_broker"))
    band = lambda test, by: by(F.when(test, F.col("price_band")), F.when(test, F.col("ord")))
    # the band when the broker's first record has come: its own if it has a minimum, else the exchange's last, else the first one
    start = F.coalesce(band((F.col("ord") == F.col("_broker")) & has_low, F.min_by), band(early & nse & has_band, F.max_by), band(early & has_band, F.min_by), band(F.col("ord") == F.col("_broker"), F.min_by))
    firsts = rows.groupBy("root").agg(start.alias("_band"), F.first("_broker").alias("_broker")).withColumn("_open", F.col("_broker").isNotNull() & F.col("_band.minimum").isNull())
    later = rows.drop("_broker").join(firsts.where("_open").select("root", "_band", "_broker"), "root").where("ord > _broker")
    # without a minimum by then, the first band fills what is missing, and then the exchange's first one with a minimum ends it
    filler = F.min(F.when(F.col("_band").isNull() & has_band, F.col("ord"))).over(whole)
    later = later.withColumn("_filler", filler)
    counts = (F.col("ord") == F.col("_filler")) | (nse & has_band & (F.col("_band").isNotNull() | (F.col("ord") > F.col("_filler"))))
    later = later.groupBy("root").agg(F.coalesce(band(counts & has_low, F.min_by), band(counts, F.max_by)).alias("_later"))
    bands = firsts.join(later, "root", "left").select("root", F.coalesce("_later", "_band").alias("price_band"))

    def first_filled(name: str) -> Column:
        return F.coalesce(F.min_by(F.when(_filled(name), F.col(name)), F.when(_filled(name), F.col("ord"))), F.max_by(name, "ord")).alias(name)

    def url(kind: str) -> Column:
        name = f"document_urls.{kind}"
        by = lambda test, most: most(F.when(test, F.col(name)), F.when(test, F.col("ord")))
        return F.coalesce(by(_filled(name) & nse, F.max_by), by(_filled(name), F.min_by)).alias(kind)

    earlier = F.coalesce(F.max(F.col("src").isin("nse", "upstox")).over(whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    overrules = _filled("bidding_start_date") & (nse | ((F.col("src") == "upstox") & ~F.col("_earlier")))
    date = F.max_by(F.when(overrules, F.col("bidding_start_date")), F.when(overrules, F.col("ord")))
    out = members.withColumn("_earlier", earlier).groupBy("root").agg(
        F.count(F.lit(1)).alias("n_members"), *[first_filled(c) for c in ("isin", "symbol", "company_name", "status", "listing_date")],
        F.coalesce(date, first_filled("bidding_start_date")).alias("bidding_start_date"), F.struct(url("rhp"), url("drhp")).alias("merged_urls"), F.min_by("document_urls", "ord").alias("own_urls"),
    )
    # a source's payload is that of its last record; there are few sources
    last = members.groupBy("root", "src").agg(F.max_by(F.element_at("raw_sources", F.col("src")), "ord").alias("payload"))
    raw = last.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("src", "payload"))).alias("raw_sources"))
    urls = F.when(F.col("n_members") > 1, F.col("merged_urls")).otherwise(F.col("own_urls")).alias("document_urls")
    met = out.join(bands, "root").join(raw, "root")
    return met.select(F.col("root").alias("first_ord"), "n_members", "isin", "symbol", "company_name", "status", "bidding_start_date", "price_band", urls, "listing_date", "raw_sources")


def _misses(keyed: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Of each record, the entities before its own whose names are similar, as both stood at its turn."""
    keys, dates = _standing(keyed.join(members, "ord"))
    named = keys.where("by_name.name <> ''").withColumn("y", F.col("by_name.name"))
    own = F.struct("isin", "symbol", "company_name", "bidding_start_date").alias("incoming")
    asks = keyed.where("name <> ''").select("ord", F.col("name").alias("x"), own).join(members.select("ord", F.col("root").alias("_own")), "ord")
    same = asks.select("x").distinct().select("x", F.col("x").alias("y"), F.lit(1.0).alias("score"))
    asks = asks.join(pairs.union(same), "x")
    met = asks.join(named, "y").where("root < _own and by_name.ord < ord")
    when = met.join(dates.withColumnRenamed("root", "_root"), (F.col("root") == F.col("_root")) & (F.col("since") < F.col("ord")) & (F.col("until").isNull() | (F.col("ord") <= F.col("until"))), "left")
    known = lambda of, c: F.when(F.col(f"{of}.ord") < F.col("ord"), F.col(f"{of}.{c}")).alias(c)
    existing = F.struct(known("by_isin", "isin"), known("by_sym", "symbol"), F.col("by_name.company_name").alias("company_name"), F.col("start").alias("bidding_start_date")).alias("existing")
    reason = F.when(F.col("score") >= SAME, "fuzzy_name_match_date_guard_failed").otherwise("near_miss_below_threshold")
    return when.select(reason.alias("reason"), "score", F.col("root").alias("first_ord"), "ord", existing, "incoming")


def deduplicate(records: DataFrame, window: int = WINDOW, near: bool = False) -> Merge:
    """Entities, near misses and members of standard records, whose ``ord`` differ and whose payload is that of their source.

    Names below ``SAME`` meet only for near misses: when those are asked for, or at once if ``near``.
    """
    scratch = Scratch(records.sparkSession, "deduplicate")
    keyed = scratch.save(_keyed(records), "keyed")
    light = keyed.select("ord", "src", "isin", "symbol", "sym", "company_name", "name", "bidding_start_date", "day")
    names = light.where("name <> ''").select("name").distinct()
    pairs = similar_names(names, scratch, NEAR if near else SAME)
    asks = pairs.where(F.col("score") >= SAME).select("x", "y")
    guess = light.join(_in_turn(light, asks, scratch, window), "ord")
    # what a record asks for by name: entities of its own and of similar names
    asks = asks.union(names.select(F.col("name").alias("x"), F.col("name").alias("y")))
    wanted = light.where("name <> '' and day is not null").select("ord", F.col("name").alias("x"), F.col("day").alias("on")).join(asks, "x").select("ord", "y", "on")
    wanted = scratch.save(wanted, "wanted")
    assigned, turn = scratch.save(guess, "guess"), 0
    while True:
        turn += 1
        assigned = scratch.save(_decided(assigned.drop("moved"), wanted), f"round-{turn}")
        if assigned.where("moved").isEmpty():
            break
        if turn > 1:
            scratch.drop(f"round-{turn - 1}")
    members = assigned.select("ord", "root", "by")
    near_pairs = lambda: pairs if near else similar_names(names, Scratch(records.sparkSession, "near-misses"))
    return Merge(_merged(keyed.join(members, "ord")), members.select("ord", F.col("root").alias("first_ord")), lambda: _misses(light, near_pairs(), members))


# --- key matches and premium matches -------------------------------------------------------------------------------


def match_on(left: DataFrame, right: DataFrame, key: Column, name: str) -> DataFrame:
    """Equi-match of two sets of records on an expression over their columns; empty keys match nothing. Right columns get the prefix r_."""
    a = left.withColumn(name, key).where(F.coalesce(F.col(name), F.lit("")) != "")
    b = right.withColumn(name, key).select(name, *[F.col(c).alias(f"r_{c}") for c in right.columns])
    return a.join(b, name)


def best_premium(entities: DataFrame, entries: DataFrame, least: float = PREMIUM) -> DataFrame:
    """Of each entity (slug, company_name) the best entry (ord, company_name, ...): an equal name first, else the highest score of at least ``least``, ties to the earliest.

    Equal names meet by an equi-join.  Only the other distinct names are scored, in blocks, behind the bound from shared characters.
    """
    scratch = Scratch(entities.sparkSession, "premium")
    ours = entities.withColumn("k", premium_key(F.col("company_name"))).where("k <> ''")
    theirs = entries.withColumn("n", premium_key(F.col("company_name"))).where("n <> ''").drop("company_name")
    first = scratch.save(theirs.withColumn("_r", F.row_number().over(Window.partitionBy("n").orderBy("ord"))).where("_r = 1").drop("_r"), "entries")
    keys = ours.select("k").distinct()
    exact = keys.join(first, keys.k == first.n).withColumn("score", F.lit(1.0))
    rest = scratch.save(keys.join(first, keys.k == first.n, "left_anti"), "rest")
    near = names_between(rest.select(F.col("k").alias("name")), first.select(F.col("n").alias("name")), least, best=True)
    scored = near.select(F.col("x").alias("k"), F.col("y").alias("_y"), "score").join(first, F.col("_y") == F.col("n")).drop("_y")
    place = F.struct(F.col("score"), (-F.col("ord")).alias("early"))
    best = scored.groupBy("k").agg(F.max_by(F.struct(*[c for c in scored.columns if c != "k"]), place).alias("s")).select("k", "s.*")
    return ours.join(exact.unionByName(best).drop("n"), "k").drop("k")


def _contained(short: DataFrame, long: DataFrame, size: int = 4) -> DataFrame:
    """Of distinct texts, pairs (s, l) where l contains s, for s of at least ``size`` characters.

    Texts meet at the runs of ``size`` characters of l; each s asks at its rarest one alone.
    """
    runs = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda k: F.substring(F.col(c), k, F.lit(size))))).alias("run")
    index = long.where(F.length("l") >= size).select("l", runs("l"))
    known = index.groupBy("run").agg(F.count(F.lit(1)).alias("k"))
    own = short.where(F.length("s") >= size).select("s", runs("s")).join(known, "run", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    asks = own.groupBy("s").agg(F.min_by("run", F.struct("k", "run")).alias("run"), F.min("k").alias("least")).where("least > 0").drop("least")
    return asks.join(index, "run").where(F.contains("l", "s")).select("s", "l")


def contained_premium(entries: DataFrame, entities: DataFrame) -> DataFrame:
    """Of each entry (ord, company_name) the first entity (ord, slug, company_name) with an equal or containing name; names below four characters contain nothing."""
    e = entries.withColumn("g", premium_key(F.col("company_name"))).where("company_name <> ''").select("ord", "g")
    i = entities.withColumn("n", premium_key(F.col("company_name"))).where("n <> ''").groupBy("n").agg(F.min(F.struct("ord", "slug")).alias("first"))
    asked, known = e.select("g").distinct(), i.select("n")
    pairs = asked.join(known, F.col("g") == F.col("n")).select("g", "n")
    pairs = pairs.union(_contained(asked.select(F.col("g").alias("s")), known.select(F.col("n").alias("l"))).select(F.col("s").alias("g"), F.col("l").alias("n")))
    pairs = pairs.union(_contained(known.select(F.col("n").alias("s")), asked.select(F.col("g").alias("l"))).select(F.col("l").alias("g"), F.col("s").alias("n")))
    met = pairs.join(i, "n").groupBy("g").agg(F.min("first").alias("first"))
    return e.join(met, "g").select("ord", F.col("first.slug").alias("slug"))


def crawl_premium(entries: DataFrame, entities: DataFrame, points: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Snapshots of entities (slug, current, percent, id) by containing names, the last of several entries on one; and one row of updated and skipped entries.

    With ``points`` (id, date, gmp) snapshots have a history too: the points, by date, of the last of an entity's entries that has any.
    """
    met = contained_premium(entries, entities).withColumnRenamed("slug", "_slug")
    all_entries = entries.join(met, "ord", "left")
    last = F.max_by(F.struct(F.col("gmp").alias("current"), F.col("gmp_percent").alias("percent"), "id"), "ord")
    snapshots = all_entries.where("_slug is not null").groupBy(F.col("_slug").alias("slug")).agg(last.alias("s")).select("slug", "s.*")
    if points is not None:
        own = points.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("date", "gmp"))).alias("history"))
        held = all_entries.where("_slug is not null").join(own, "id").groupBy(F.col("_slug").alias("slug")).agg(F.max_by("history", "ord").alias("history"))
        snapshots = snapshots.join(held, "slug", "left")
    return snapshots, all_entries.agg(F.count("_slug").alias("updated"), F.count_if(F.col("_slug").isNull()).alias("skipped"))
