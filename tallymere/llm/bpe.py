"""Byte-level BPE encoding and decoding with an index of pair occurrences.

Texts are cut into words by the pattern of the vocabulary (runs of letters,
numbers, other characters or white space, with a leading space or as a short
form after an apostrophe).  The different words of a block of texts lie one
after another in one linked list of symbols, and an index maps each pair of
neighbours that has a rank to all its positions.  The lowest rank that the
index holds is applied at all its positions at once; the pairs that this makes
with the symbols before and after join the lists of their own ranks.  As a
merged symbol only occurs in pairs of higher rank (checked when a vocabulary is
built), ranks are taken in ascending order, and every word is merged as it
would be by itself.

A task keeps the ids of words that it has met, up to a bound; forgetting them
changes no result.  What a task holds depends on a block of texts, or on one text
where that is larger.  Executors get the vocabulary, whose size is its own.

Defined results: a null text has null ids and decodes to null, an empty text
has no ids and decodes to an empty text; special tokens in a text become their
ids unless ``special`` is false; ids that form no UTF-8 decode to replacement
characters.  Input columns are kept inside the struct ``row``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import _ranges
from .texthash import bounded_batches, by_blocks

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text that are encoded together.
BLOCK = 8 << 20
#: Words, and bytes of words, that a task remembers.
KNOWN_WORDS, KNOWN_BYTES = 300_000, 8 << 20

OTHER, LETTER, NUMBER, BLANK, SPECIAL = range(5)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """Class of each code point. They follow the Unicode version of the tokenizers library, so it is asked, once."""
    from tokenizers import Regex, pre_tokenizers

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for found, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def _byte_letters() -> dict[str, int]:
    """The letter that spells each byte: itself where it is printable, else the next of those from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class ByteBPE:
    """A vocabulary: its merges by rank, its tokens as bytes, its special tokens."""

    classes: np.ndarray  #: of each code point
    first: np.ndarray  #: id of the token of each byte
    keys: np.ndarray  #: pairs of ids that merge, left << 32 | right, in order, and an end mark
    ranks: np.ndarray  #: of the pairs in ``keys``
    left: np.ndarray  #: by rank
    right: np.ndarray
    merged: np.ndarray
    raw: np.ndarray  #: bytes of all tokens
    raw_ends: np.ndarray
    special: dict[bytes, int]

    @classmethod
    def build(cls, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[bytes, int]) -> ByteBPE:
        left, right, merged = (np.array([tokens[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        made = np.full(max([*tokens.values(), *special.values()]) + 1, -1)
        made[merged] = np.arange(len(merges))
        if len(np.unique(merged)) < len(merges) or (np.maximum(made[left], made[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge must come after those that make its parts, and no two may make the same token")
        order = np.argsort(left << 32 | right)
        keys = np.append((left << 32 | right)[order], np.iinfo(np.int64).max)  # the last stands behind every pair
        spelt = [b""] * len(made)
        for text, i in [*tokens.items(), *special.items()]:
            spelt[i] = text
        first = np.array([tokens[bytes([b])] for b in range(256)], np.int64)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in spelt])])
        return cls(_classes(), first, keys, np.append(order, -1), left, right, merged, np.frombuffer(b"".join(spelt), np.uint8), ends, special)

    @classmethod
    def load(cls, path: str | None = None) -> ByteBPE:
        """From a tokenizers file of a byte-level BPE model. It is read on the driver."""
        with open(path or vocabulary_path(), encoding="utf-8") as file:
            spec = json.load(file)
        byte = _byte_letters()
        spell = lambda token: bytes(byte[ch] for ch in token)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        tokens = {spell(t): i for t, i in spec["model"]["vocab"].items() if i not in special.values()}
        return cls.build(tokens, [(spell(a), spell(b)) for a, b in merges], special)

    # --- words -------------------------------------------------------------------------------------------------

    def words(self, raw: bytes, bounds: np.ndarray, special: bool = True) -> np.ndarray:
        """Byte offsets at which words start. ``bounds``: offsets of the texts, and the end."""
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            return np.zeros(0, np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # of each character
        code = data if len(at) == len(data) else np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        kind = self.classes[code]
        edge = np.zeros(len(kind) + 1, bool)
        edge[np.searchsorted(at, bounds)] = True
        if special and self.special:
            self._mark_special(raw, at, bounds, kind, edge)
        return at[self._word_starts(code, kind, edge)]

    def _mark_special(self, raw: bytes, at: np.ndarray, bounds: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> None:
        if not any(s in raw for s in self.special):
            return
        longest_first = sorted(self.special, key=len, reverse=True)
        pattern = re.compile(b"|".join(map(re.escape, longest_first)))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for found in pattern.finditer(raw, lo, hi):
                a, b = np.searchsorted(at, found.span())
                kind[a:b] = SPECIAL
                edge[[a, b]] = True

    @staticmethod
    def _word_starts(code: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Characters at which words start; texts and special tokens start at ``edge``."""
        n = len(kind)
        run = edge[:n].copy()
        run[0] = True
        run[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(run)
        size = np.diff(np.append(start, n))
        what = kind[start]
        follows = np.append(~edge[start[1:]], False)  # another run of the same text does
        last = start + size - 1
        lends = (what == BLANK) & follows  # its last character is for the next word, or alone
        spaced = np.append(False, (lends & (code[last] == 0x20))[:-1])  # begins with the space before
        out = np.zeros(n + 1, bool)
        out[start[~spaced & ((what != BLANK) | ~lends | (size > 1))]] = True
        out[last[lends]] = True
        # an apostrophe by itself, and the letters that make a short form with it
        short = np.flatnonzero((code[start] == 0x27) & (size == 1) & (what == OTHER) & ~spaced & follows)
        short = short[what[np.minimum(short + 1, len(what) - 1)] == LETTER]
        if len(short):
            letters = np.append(code, [0, 0]).astype(np.int64)
            one, two = letters[start[short] + 1], letters[start[short] + 2]
            long_enough = size[short + 1] > 1
            taken = np.where(np.isin(one, [ord(x) for x in "stmd"]), 1, 0)
            for a, b in ("re", "ve", "ll"):
                taken[(one == ord(a)) & (two == ord(b)) & long_enough] = 2
            short, taken = short[taken > 0], taken[taken > 0]
            out[start[short + 1]] = False
            more = size[short + 1] > taken
            out[(start[short + 1] + taken)[more]] = True
        return np.flatnonzero(out[:n])

    # --- merges ------------------------------------------------------------------------------------------------

    def merge(self, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (their bytes one after another in ``raw``), and how many each has."""
        n = len(raw)
        ends = np.cumsum(sizes)
        place = np.int32 if n < 1 << 31 else np.int64
        symbol = np.append(self.first[np.frombuffer(raw, np.uint8)], -1).astype(np.int32)  # -1: merged into the one before, or no symbol
        after, before = np.arange(1, n + 2, dtype=place), np.arange(-1, n, dtype=place)
        after[n:] = before[n:] = n
        after[ends[sizes > 0] - 1] = n
        before[(ends - sizes)[sizes > 0]] = n
        waiting: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Adds positions of pairs to the index."""
            pair = symbol[at].astype(np.int64) << 32 | symbol[after[at]]
            place = self.keys.searchsorted(pair)
            hit = self.keys[place] == pair
            at, rank = at[hit], self.ranks[place[hit]]
            if len(at) > 8:
                order = rank.argsort(kind="stable")
                at, rank = at[order], rank[order]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                ranks, bounds = rank[np.append(0, cuts)].tolist(), [0, *cuts.tolist(), len(at)]
            else:
                ranks, bounds = rank.tolist(), range(len(at) + 1)
            for k, r in enumerate(ranks):
                own = at[bounds[k] : bounds[k + 1]]
                if r in waiting:
                    waiting[r].append(own)
                else:
                    waiting[r] = [own]
                    heappush(active, r)

        for lo in range(0, n, 1 << 18):
            note(np.arange(lo, min(n, lo + (1 << 18))))
        while active:
            r = heappop(active)
            listed = waiting.pop(r)
            at = listed[0] if len(listed) == 1 else np.concatenate(listed)
            left, right = self.left[r], self.right[r]
            at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
            if not len(at):
                continue
            if left == right:  # in a run of equal symbols every other pair merges, from the left
                at = np.unique(at)
                place = np.arange(len(at))
                fresh = np.append(True, after[at[:-1]] != at[1:])
                at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            gone = after[at]
            rest = after[gone]
            symbol[at], symbol[gone] = self.merged[r], -1
            after[at] = rest
            before[rest] = at
            earlier = before[at]
            note(np.concatenate([earlier[earlier < n], at[rest < n]]))
        kept = symbol[:n] >= 0
        total = np.concatenate([[0], np.cumsum(kept)])
        return symbol[:n][kept], total[ends] - total[ends - sizes]

    def encode(self, text: pa.Array, known: Known | None = None, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets."""
        data = [x or b"" for x in text.cast(pa.binary()).to_pylist()]
        raw = b"".join(data)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        starts = self.words(raw, bounds, special)
        place, ids, counts = (known or Known(self, special)).encode(raw, starts)
        each = counts[place]
        out = ids[_ranges((np.cumsum(counts) - counts)[place], each)]
        return out, np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, bounds)]

    def encode_apart(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As encode without special tokens, for texts that share few words: nothing is looked up or remembered."""
        raw = b"".join(texts)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        starts = self.words(raw, bounds, special=False)
        ids, counts = self.merge(raw, np.diff(np.append(starts, len(raw))))
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        ids = ids.astype(np.int64)
        sizes = np.diff(self.raw_ends)[ids]
        raw = self.raw[_ranges(self.raw_ends[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets].tolist()
        return [raw[lo:hi].decode(errors="replace") for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


class Known:
    """Ids of the words that a task has met."""

    def __init__(self, bpe: ByteBPE, special: bool = True):
        self.bpe, self.special = bpe, bpe.special if special else {}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.counts, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def encode(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words from each start to the next, which of the known words each is; ids of the known words, and how many each has."""
        ends = np.append(starts, len(raw))
        # words of a block are told apart by Arrow; offsets beyond 2**31 need its large type
        wide = len(raw) >= 1 << 31
        words = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64 if wide else np.int32).tobytes()), pa.py_buffer(raw)]).dictionary_encode()
        own = words.dictionary.to_pylist()
        if len(self.place) > KNOWN_WORDS or self.bytes > KNOWN_BYTES:
            self._forget()
        fresh = [w for w in own if w not in self.place]
        if fresh:
            plain = [b"" if w in self.special else w for w in fresh]
            ids, counts = self.bpe.merge(b"".join(plain), np.array([len(w) for w in plain], np.int64))
            marked = [k for k, w in enumerate(fresh) if w in self.special]
            if marked:
                ids = np.insert(ids, (np.cumsum(counts) - counts)[marked], [self.special[fresh[k]] for k in marked])
                counts[marked] = 1
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            self.bytes += sum(map(len, fresh))
        place = np.array([self.place[w] for w in own], np.int64)
        return place[words.indices.to_numpy()] if len(own) else place, self.ids, self.counts


def encode(docs: DataFrame, bpe: ByteBPE, text: str = "text", special: bool = True, decoded: bool = False) -> DataFrame:
    """Columns row (struct of the input's columns), ids (array<int>), and with ``decoded`` what the ids decode to, in the same pass."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(shared.value, special)

        def convert(part: pa.RecordBatch) -> pa.RecordBatch:
            own = pc.struct_field(part["row"], text)
            ids, offsets = shared.value.encode(own, known, special)
            out = {"row": part["row"], "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=own.is_null())}
            if decoded:
                out["decoded"] = pa.array(shared.value.decode(ids, offsets), pa.string(), mask=own.is_null().to_numpy(zero_copy_only=False))
            return pa.RecordBatch.from_pydict(out)

        return by_blocks(batches, lambda batch: pc.struct_field(batch["row"], text), convert, BLOCK)

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, bpe: ByteBPE) -> DataFrame:
    """Adds ``decoded`` to a column ids; the others are kept in the struct ``row``."""
    bounded_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = part["ids"]
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
                texts = shared.value.decode(ids.flatten().to_numpy(zero_copy_only=False), offsets)
                yield pa.RecordBatch.from_pydict({"row": part["row"], "ids": ids, "decoded": pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))})

    packed = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns if c != "ids"]).alias("row"), "ids")
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>, decoded string")


def op11_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, ByteBPE.load(), decoded=True)
    listed = F.coalesce(F.concat_ws(",", F.col("ids").cast("array<string>")), F.lit(""))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"), F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"),
    )
