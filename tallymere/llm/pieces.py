"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each character
its output links give the pieces that end there, and each relaxes the best
score at that place.  The path of best scores is the encoding.  Texts are cut
where no piece can cross: before a space mark, if the vocabulary has no piece
with a space mark after another character (else they are not), and in long
words between two characters that are neighbours in no piece.  Each different
part of a block is encoded once; short parts advance through the automaton side
by side, in numpy arrays, and long ones character by character.

The model file is read on the driver; what executors get is the automaton,
whose size depends on the vocabulary alone.  The best path need not equal the
merge order of a vocabulary that was trained by merging.

Defined results: a null text has null ids and decodes to null, an empty text
has no ids; characters without a piece become byte pieces, at a score below
that of all pieces; of paths with equal scores the one with the longer last
piece wins.  Decoding gives the text back, with U+2581 as a space, as in the
format itself.  Input columns are kept inside the struct ``row``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texthash import bounded_batches, by_blocks, mix

SPACE = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
_EMPTY = np.uint64((1 << 64) - 1)
#: Bytes of a word from which it is cut between characters, and characters of a part from which it is taken alone.
LONG_WORD, LONG_PART = 64, 192


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start to start + size - 1 of each pair, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


@dataclass
class Pieces:
    """Automaton and pieces of a vocabulary."""

    keys: np.ndarray  #: open-addressed table of state << 21 | character
    targets: np.ndarray
    fail: np.ndarray  #: by state
    piece: np.ndarray  #: by state, the piece that ends there or -1
    link: np.ndarray  #: by state, the next state on the fail path where a piece ends, or 0
    size: np.ndarray  #: by piece, in characters
    score: np.ndarray
    unknown_score: float
    first_byte: int  #: id of byte piece 0
    raw: np.ndarray  #: bytes of all pieces, space marks as spaces
    raw_ends: np.ndarray
    inner: np.ndarray  #: neighbours in pieces, first << 21 | second, in order

    @classmethod
    def build(cls, pieces: list[str], scores: list[float], usable: list[bool], first_byte: int) -> Pieces:
        """``usable``: the pieces that can match text (neither control nor byte pieces)."""
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for i, (text, ok) in enumerate(zip(pieces, usable, strict=True)):
            if not ok or not text:
                continue
            state = 0
            for code in map(ord, text):
                if code not in children[state]:
                    children[state][code] = len(children)
                    children.append({})
                    piece.append(-1)
                state = children[state][code]
            piece[state] = i
        n = len(children)
        fail, link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        queue = deque(children[0].values())
        while queue:
            state = queue.popleft()
            back = fail[state]
            link[state] = back if piece[back] >= 0 else link[back]
            for code, to in children[state].items():
                other = back
                while other and code not in children[other]:
                    other = fail[other]
                fail[to] = children[other].get(code, 0)
                queue.append(to)
        width = 1 << (4 * n).bit_length()
        keys, targets = np.full(width, _EMPTY), np.zeros(width, np.int32)
        edges = [((state << 21) | code, to) for state, own in enumerate(children) for code, to in own.items()]
        places = mix(np.array([k for k, _ in edges], np.uint64)) & np.uint64(width - 1)
        for (key, to), at in zip(edges, places.tolist(), strict=True):
            while keys[at] != _EMPTY:
                at = (at + 1) % width
            keys[at], targets[at] = key, to
        raw = [bytes([i - first_byte]) if first_byte <= i < first_byte + 256 else (p.replace(SPACE, " ").encode() if ok else b"") for i, (p, ok) in enumerate(zip(pieces, usable, strict=True))]
        used = [p for p, ok in zip(pieces, usable, strict=True) if ok]
        inner = np.unique(np.array([(ord(a) << 21) | ord(b) for p in used for a, b in zip(p, p[1:])], np.int64))
        return cls(
            keys, targets, fail, np.array(piece, np.int32), link, np.array([len(p) for p in pieces], np.int32), np.array(scores),
            min(s for s, ok in zip(scores, usable, strict=True) if ok) - 10, first_byte, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), inner,
        )

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        usable = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
        return cls.build([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], usable, next(i for i in ids if model.is_byte(i)))

    def _child(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The state below, or 0."""
        key = (state.astype(np.uint64) << np.uint64(21)) | code
        mask = np.uint64(len(self.keys) - 1)
        at = mix(key) & mask
        out = np.zeros(len(key), np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            own = self.keys[at[open_]]
            hit = own == key[open_]
            out[open_[hit]] = self.targets[at[open_[hit]]]
            open_ = open_[~hit & (own != _EMPTY)]
            at[open_] = (at[open_] + np.uint64(1)) & mask
        return out

    def _step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        state = state.copy()
        out = self._child(state, code)
        miss = np.flatnonzero((out == 0) & (state != 0))
        while len(miss):
            state[miss] = self.fail[state[miss]]
            out[miss] = self._child(state[miss], code[miss])
            miss = miss[(out[miss] == 0) & (state[miss] != 0)]
        return out

    def best_paths(self, code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best path of each part (its characters one after another in ``code``), and how many each has."""
        n, total = len(sizes), len(code) + len(sizes)
        start = np.cumsum(sizes + 1) - sizes - 1  # place 0 of each part; place j is after j characters
        best, came = np.full(total, -np.inf), np.zeros(total, np.int32)
        back = np.ones(total, np.int32)
        best[start] = 0
        order = np.argsort(-sizes, kind="stable")
        ordered, base = sizes[order], start[order]
        source = base - order  # a part has one place more than characters
        active = np.searchsorted(-ordered, -np.arange(ordered[0] if n else 0), "left")
        state = np.zeros(n, np.int32)
        for j, k in enumerate(active):
            c = code[source[:k] + j]
            state[:k] = own = self._step(state[:k], c.astype(np.uint64))
            place = base[:k] + j + 1
            top, top_piece, top_size = np.full(k, -np.inf), np.zeros(k, np.int32), np.ones(k, np.int32)
            at = np.where(self.piece[own] >= 0, own, self.link[own])
            live = np.flatnonzero(at)
            single = np.zeros(k, bool)
            while len(live):
                p = self.piece[at[live]]
                size = self.size[p]
                single[live] |= size == 1
                score = best[place[live] - size] + self.score[p]
                won = score > top[live]
                chosen = live[won]
                top[chosen], top_piece[chosen], top_size[chosen] = score[won], p[won], size[won]
                at[live] = self.link[at[live]]
                live = live[at[live] != 0]
            score = best[place - 1] + self.unknown_score
            won = ~single & (score > top)
            top[won], top_piece[won], top_size[won] = score[won], -1 - c[won].astype(np.int32), 1
            best[place], came[place], back[place] = top, top_piece, top_size
        ends = np.zeros(total, bool)
        at = start + sizes
        at = at[sizes > 0]
        floor = start[sizes > 0]
        while len(at):
            ends[at] = True
            at = at - back[at]
            more = at > floor
            at, floor = at[more], floor[more]
        place = np.flatnonzero(ends)
        ids = came[place]
        counts = np.bincount(np.searchsorted(start, place, "right") - 1, minlength=n)
        return self._with_bytes(ids, counts)

    def long_path(self, code: list[int]) -> np.ndarray:
        """As best_paths for one part, a character at a time; before characters without a piece become bytes."""
        if not hasattr(self, "_lists"):
            full = np.flatnonzero(self.keys != _EMPTY)
            children = dict(zip(self.keys[full].tolist(), self.targets[full].tolist(), strict=True))
            self._lists = (children, *[x.tolist() for x in (self.fail, self.piece, self.link, self.size, self.score)])
        children, fail, piece, link, size, score = self._lists
        best, came, back, state = [0.0], [0], [1], 0
        for j, c in enumerate(code):
            to = children.get(state << 21 | c, 0)
            while not to and state:
                state = fail[state]
                to = children.get(state << 21 | c, 0)
            state = to
            top, top_piece, top_size, single = -np.inf, 0, 1, False
            at = state if piece[state] >= 0 else link[state]
            while at:
                p = piece[at]
                n = size[p]
                single |= n == 1
                own = best[j + 1 - n] + score[p]
                if own > top:
                    top, top_piece, top_size = own, p, n
                at = link[at]
            if not single and best[j] + self.unknown_score > top:
                top, top_piece, top_size = best[j] + self.unknown_score, -1 - c, 1
            best.append(top)
            came.append(top_piece)
            back.append(top_size)
        ids, at = [], len(code)
        while at > 0:
            ids.append(came[at])
            at -= back[at]
        return np.array(ids[::-1], np.int32)

    def all_paths(self, code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best path of each part, whatever its size, and how many each has."""
        long = np.flatnonzero(sizes > LONG_PART)
        if not len(long):
            return self.best_paths(code, sizes)
        start = np.cumsum(sizes) - sizes
        short = np.flatnonzero(sizes <= LONG_PART)
        own, own_counts = self.best_paths(code[_ranges(start[short], sizes[short])], sizes[short])
        alone = [self.long_path(code[start[i] : start[i] + sizes[i]].tolist()) for i in long]
        rest, rest_counts = self._with_bytes(np.concatenate(alone), np.array([len(x) for x in alone]))
        counts = np.zeros(len(sizes), np.int64)
        counts[short], counts[long] = own_counts, rest_counts
        place = np.cumsum(counts) - counts
        ids = np.zeros(counts.sum(), np.int32)
        ids[_ranges(place[short], own_counts)] = own
        ids[_ranges(place[long], rest_counts)] = rest
        return ids, counts

    def _cuts(self, word: bytes) -> np.ndarray:
        """Bytes of a word, after its first, before which no piece crosses."""
        code = np.frombuffer(word.decode().replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        pair = (code[:-1] << 21) | code[1:]
        at = np.minimum(np.searchsorted(self.inner, pair), max(len(self.inner) - 1, 0))
        open_ = self.inner[at] != pair if len(self.inner) else np.ones(len(pair), bool)
        width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        width[code == ord(SPACE)] = 1
        return np.cumsum(width)[:-1][open_]

    def _with_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece (-1 - character) become their UTF-8 bytes."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, counts
        size = np.ones(len(ids), np.int64)
        found, which = np.unique(-1 - ids[odd], return_inverse=True)
        spelt = [chr(c).encode() for c in found]
        sizes = np.array([len(x) for x in spelt])
        flat = np.frombuffer(b"".join(spelt), np.uint8)
        size[odd] = sizes[which]
        out = np.repeat(ids, size)
        out[out < 0] = self.first_byte + flat[_ranges((np.cumsum(sizes) - sizes)[which], sizes[which])].astype(np.int32)
        part = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(part, size, minlength=len(counts)).astype(np.int64)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets."""
        data = [b" " + x.replace(SPACE.encode(), b" ") if x else b"" for x in text.cast(pa.binary()).to_pylist()]
        raw = b"".join(data)
        buffer = np.frombuffer(raw, np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        space = buffer == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        if not self._splits_before_spaces():
            first[:] = False
        first[bounds[:-1][bounds[:-1] < len(buffer)]] = True
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(buffer)))
        more = [start + self._cuts(raw[start : start + size]) for start, size in zip(starts[sizes > LONG_WORD].tolist(), sizes[sizes > LONG_WORD].tolist(), strict=True)]
        if more:
            starts = np.sort(np.concatenate([starts, *more]))
        ends = np.append(starts, len(buffer)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)]).dictionary_encode()
        known = [x.decode().replace(" ", SPACE) for x in parts.dictionary.to_pylist()]
        sizes = np.array([len(x) for x in known], np.int64)
        code = np.frombuffer("".join(known).encode("utf-32-le"), np.uint32)
        ids, counts = self.all_paths(code, sizes)
        index = parts.indices.to_numpy()
        each = counts[index]
        out = ids[_ranges((np.cumsum(counts) - counts)[index], each)]
        offsets = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, bounds)]
        return out, offsets

    def _splits_before_spaces(self) -> bool:
        """No piece has a space mark after another character."""
        before, after = self.inner >> 21, self.inner & ((1 << 21) - 1)
        return not ((after == ord(SPACE)) & (before != ord(SPACE))).any()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        sizes = np.diff(self.raw_ends)[ids]
        raw = self.raw[_ranges(self.raw_ends[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        return [raw[lo + (raw[lo : lo + 1] == b" ") : hi].decode(errors="replace") for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", decoded: bool = False) -> DataFrame:
    """Columns row (struct of the input's columns), ids (array<int>), and with ``decoded`` what the ids decode to, in the same pass."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def convert(part: pa.RecordBatch) -> pa.RecordBatch:
        own = pc.struct_field(part["row"], text)
        ids, offsets = shared.value.encode(own)
        out = {"row": part["row"], "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=own.is_null())}
        if decoded:
            out["decoded"] = pa.array(shared.value.decode(ids, offsets), pa.string(), mask=own.is_null().to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_blocks(batches, lambda batch: pc.struct_field(batch["row"], text), convert)

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """Adds ``decoded`` to a column ids; the others are kept in the struct ``row``."""
    bounded_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = part["ids"]
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
                texts = shared.value.decode(ids.flatten().to_numpy(), offsets)
                yield pa.RecordBatch.from_pydict({"row": part["row"], "ids": ids, "decoded": pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))})

    packed = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns if c != "ids"]).alias("row"), "ids")
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>, decoded string")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = Pieces.load()
    out = encode(docs, pieces, decoded=True)
    same = F.col("decoded").eqNullSafe(F.replace("row.text", F.lit(SPACE), F.lit(" ")))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))
