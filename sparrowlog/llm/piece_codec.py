"""SentencePiece encoding and decoding over a relational lattice.

Within each Arrow batch the lattice is built as relations of numpy columns:
distinct words explode into substrings of bounded length, those are equi-joined
with the piece table, and the edges are grouped by word.  A fold over each
word's edges then gives its pieces:

* ``unigram`` models fold Viterbi's recursion: the best score of each prefix;
* ``bpe`` models define their result by the order of merges, which a best path
  does not reproduce, so the fold applies the cheapest edge that joins two
  neighbouring pieces until none is left.

A word here is a run of characters that pieces can span: wherever no piece
holds two neighbouring characters side by side, the text is cut, which cannot
change the result.  Nothing of a text is dropped; characters without a piece
become byte pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, sent, tidy, with_text
from ._text import Powers, chunks, mix, utf8

SPACE = 0x2581  # the sign that stands for a space within pieces
#: Bits of the bitmap that substrings pass before they are joined, and of the bitmap of neighbouring characters.
BITS = 22
#: Longest word that is folded in a matrix; a longer one is merged with a heap.
MATRIX = 48
NONE = np.int32(2**31 - 1)


@dataclass
class PieceTable:
    """``pieces[rank]``: text of each ordinary piece, best score first; ``ids`` and ``scores`` go with it."""

    pieces: list[str]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray  # of the 256 byte pieces, -1 where there is none
    unknown_id: int
    kind: str  # "bpe" or "unigram"
    raw: list[bytes] = field(repr=False)  # what each id decodes to
    dummy_space: bool = True


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; a value is a number or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            x = data[at]
            at += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield tag >> 3, data[at : at + size]
        at += size


#: Fixed values of the model format: what its trainer's settings (field 2) give as the model's type (field 3).
KINDS = {1: "unigram", 2: "bpe", 3: "word", 4: "char"}


def kind_of(data: bytes) -> str:
    """The kind of a model by its own file."""
    settings = next((v for k, v in _fields(data) if k == 2), b"")
    return KINDS[next((v for k, v in _fields(settings) if k == 3), 1)]


def load_model(path: str) -> PieceTable:
    """The piece table of a model file of kind bpe or unigram; the driver reads it, executors get it as a broadcast bound by the vocabulary."""
    from sentencepiece import SentencePieceProcessor

    with open(path, "rb") as f:
        data = f.read()
    kind = kind_of(data)
    if kind not in ("bpe", "unigram"):
        raise ValueError(f"models of kind {kind} are not encoded")
    sp = SentencePieceProcessor(model_proto=data)
    n = sp.get_piece_size()
    byte_ids, raw, own = np.full(256, -1, np.int32), [], []
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            raw.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unused(i):
            raw.append(b"")
        elif sp.is_unknown(i):
            raw.append(" ⁇ ".encode())
        else:
            raw.append(p.replace(chr(SPACE), " ").encode())
            own.append((-sp.get_score(i), i, p))
    own.sort()
    return PieceTable([p for _, _, p in own], np.array([i for _, i, _ in own], np.int32), np.array([-s for s, _, _ in own]), byte_ids, sp.unk_id(), kind, raw)


class Lattice:
    """A piece table's join columns, built once in each task."""

    def __init__(self, t: PieceTable):
        self.t, self.powers = t, Powers()
        self.rank = {p: r for r, p in enumerate(t.pieces)}
        self.longest = max((len(p) for p in t.pieces), default=1)
        self.single = np.full(0x110000, -1, np.int32)
        for p, r in self.rank.items():
            if len(p) == 1:
                self.single[ord(p)] = r
        flat = np.array([ord(c) for p in t.pieces for c in p], np.uint32)
        ends = np.cumsum([len(p) for p in t.pieces]) if t.pieces else np.zeros(0, np.int64)
        starts = ends - np.array([len(p) for p in t.pieces], np.int64) if t.pieces else ends
        h = self.hashes(flat, starts, ends)
        self.order = np.argsort(h)
        self.keys = h[self.order]
        self.mask = np.zeros(1 << BITS, bool)
        self.mask[(h >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.near = np.zeros(1 << BITS, bool)
        inner = np.ones(len(flat), bool)
        if len(flat):
            inner[ends - 1] = False
        at = np.flatnonzero(inner)
        self.near[self._pair(flat[at], flat[at + 1])] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix((a.astype(np.uint64) << np.uint64(32)) | b) >> np.uint64(64 - BITS)).astype(np.int64)

    def sums(self, chars: np.ndarray) -> np.ndarray:
        self.powers.reach(len(chars) + 1)
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * self.powers.up[: len(chars)], out=total[1:])
        return total

    def span(self, total: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((total[e] - total[s]) * self.powers.down[s] + (e - s).astype(np.uint64))

    def hashes(self, chars: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return self.span(self.sums(chars), s, e)

    def join(self, h: np.ndarray) -> np.ndarray:
        """The rank of the piece that each hash stands for, or NONE."""
        out = np.full(h.shape, NONE, np.int32)
        hit = np.flatnonzero(self.mask[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        if len(hit):
            x = h.reshape(-1)[hit]
            at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
            ok = self.keys[at] == x
            out.reshape(-1)[hit[ok]] = self.order[at[ok]]
        return out

    def edges(self, total: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """edges[w, i, n]: rank of the piece of n characters at i in word w, or NONE."""
        most = min(self.longest, length)
        out = np.full((len(starts), length + 1, most + 1), NONE, np.int32)
        for n in range(2, most + 1):
            s = starts[:, None] + np.arange(length - n + 1)
            h = self.span(total, s, s + n)
            out[:, : length - n + 1, n] = self.join(h.reshape(-1)).reshape(h.shape)
        return out

    def merged(self, edges: np.ndarray, length: int) -> np.ndarray:
        """size[w, i]: length of the piece that starts at i, 0 if none does; by the order of merges."""
        m, most = len(edges), edges.shape[2] - 1
        size = np.ones((m, length), np.int64)
        before = np.tile(np.arange(-1, length - 1), (m, 1))
        rank = np.full((m, length), NONE, np.int32)
        if most >= 2:
            rank[:, : length - 1] = edges[:, : length - 1, 2]
        live = np.arange(m)
        while len(live):
            i = rank[live].argmin(1)
            on = rank[live, i] != NONE
            live, i = live[on], i[on]
            if not len(live):
                break
            j = i + size[live, i]
            joined = size[live, i] + size[live, j]
            size[live, i], size[live, j], rank[live, j] = joined, 0, NONE
            k = i + joined
            inside = k < length
            w, i2, k2 = live[inside], i[inside], k[inside]
            before[w, k2] = i2
            n = size[w, i2] + size[w, k2]
            rank[live, i] = NONE
            rank[w, i2] = np.where(n <= most, edges[w, i2, np.minimum(n, most)], NONE)
            p = before[live, i]
            w, p2, i2 = live[p >= 0], p[p >= 0], i[p >= 0]
            n = size[w, p2] + size[w, i2]
            rank[w, p2] = np.where(n <= most, edges[w, p2, np.minimum(n, most)], NONE)
        return size

    def merged_long(self, word: str) -> list[str]:
        """The same for one long word, in time n log n."""
        n = len(word)
        after, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if not alive[i] or after[i] >= n:
                continue
            j = after[i]
            if after[j] - i != size:
                continue  # one of the two has been merged since
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                back[after[j]] = i
            for a in (back[i], i):
                if a >= 0 and after[a] < n:
                    e = after[after[a]]
                    if e - a <= self.longest and (r := self.rank.get(word[a:e])) is not None:
                        heapq.heappush(heap, (r, a, e - a))
        return [word[i : after[i]] for i in range(n) if alive[i]]

    def viterbi(self, total: np.ndarray, chars: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """size[w, i] of the best-scored path; an unknown character costs 10 more than the worst piece."""
        edges = self.edges(total, starts, length)
        most = edges.shape[2] - 1
        scores = np.append(self.t.scores, -np.inf)
        low = (self.t.scores.min() if len(self.t.scores) else 0.0) - 10
        one = self.single[chars[starts[:, None] + np.arange(length)]]
        best = np.full((len(starts), length + 1), -np.inf)
        best[:, 0] = 0
        came = np.zeros((len(starts), length + 1), np.int64)
        for e in range(1, length + 1):
            for n in range(min(most, e), 0, -1):
                s = np.where(one[:, e - 1] >= 0, scores[one[:, e - 1]], low) if n == 1 else scores[np.minimum(edges[:, e - n, n], len(scores) - 1)]
                x = best[:, e - n] + s
                better = x > best[:, e]
                best[better, e], came[better, e] = x[better], n
        size = np.zeros((len(starts), length), np.int64)
        at = np.full(len(starts), length)
        w = np.arange(len(starts))
        while len(w):
            n = came[w, at[w]]
            at[w] -= n
            size[w, at[w]] = n
            w = w[at[w] > 0]
        return size

    def words(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, end to end, and their offsets."""
        total = self.sums(chars)
        w_of, pos_of, id_of = [], [], []
        rank_id = self.t.ids

        def out(w, i, rank, where):
            """Pieces ``rank`` of words ``w`` at character ``i``; a negative rank is an unknown character at ``where``."""
            ok = rank >= 0
            w_of.append(w[ok]); pos_of.append(i[ok] * 4); id_of.append(rank_id[rank[ok]])
            for x, y, c in zip(w[~ok], i[~ok], chars[where[~ok]]):
                raw = chr(c).encode("utf-8", "surrogatepass")
                ids = [self.t.byte_ids[b] for b in raw]
                ids = ids if min(ids) >= 0 else [self.t.unknown_id]
                w_of.append(np.full(len(ids), x)); pos_of.append(np.arange(len(ids)) + 4 * y); id_of.append(np.array(ids, np.int32))

        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            if n == 1:
                out(own, np.zeros(len(own), np.int64), self.single[chars[starts[own]]], starts[own])
                continue
            if n > MATRIX and self.t.kind == "bpe":
                for w in own:
                    word, i = "".join(map(chr, chars[starts[w] : starts[w] + n])), 0
                    for p in self.merged_long(word):
                        out(np.array([w]), np.array([i]), np.array([self.rank.get(p, -1)]), np.array([starts[w] + i]))
                        i += len(p)
                continue
            step = max(1, (1 << 22) // (int(n) * (min(self.longest, int(n)) + 1)))
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                at = starts[part]
                edges = self.edges(total, at, int(n))
                size = self.merged(edges, int(n)) if self.t.kind == "bpe" else self.viterbi(total, chars, at, int(n))
                w, i = np.nonzero(size)
                k = size[w, i]
                rank = np.where(k == 1, self.single[chars[at[w] + i]], edges[w, i, np.minimum(k, edges.shape[2] - 1)])
                out(part[w], i, rank, at[w] + i)
        w, pos, ids = np.concatenate(w_of), np.concatenate(pos_of), np.concatenate(id_of)
        count = np.bincount(w, minlength=len(starts))
        order = np.lexsort((pos, w))
        return ids[order], np.concatenate([[0], np.cumsum(count)])

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets) for runs of texts, in order; a null text has no ids."""
        data, off = utf8(column)
        for i, j in chunks(off):
            part, rel = data[off[i] : off[j]], off[i : j + 1] - off[i]
            if not len(part):
                yield np.zeros(0, np.int32), np.zeros(j - i + 1, np.int64)
                continue
            chars = np.frombuffer(part.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[rel]
            chars = np.where(chars == 0x20, np.uint32(SPACE), chars)
            full = np.flatnonzero(np.diff(at) > 0)
            bounds = at
            if self.t.dummy_space:
                chars = np.insert(chars, at[full], SPACE)
                bounds = at + np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
            known = self.single[chars] >= 0
            cut = np.ones(len(chars), bool)  # a word begins here
            cut[1:] = ~(known[1:] & known[:-1] & self.near[self._pair(chars[:-1], chars[1:])])
            cut[bounds[:-1][np.diff(bounds) > 0]] = True
            s = np.flatnonzero(cut)
            e = np.append(s[1:], len(chars))
            h = self.hashes(chars, s, e)
            _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            ids, to = self.words(chars, s[first], (e - s)[first])
            count = np.diff(to)[inverse]
            ends = np.cumsum(count)
            flat = np.repeat(to[inverse] - (ends - count), count) + np.arange(ends[-1])
            words_before = np.searchsorted(s, bounds)
            yield ids[flat], np.concatenate([[0], ends])[words_before]


def encode(docs: DataFrame, model: PieceTable, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``'s columns with ``ids array<int>`` for each row; a null or empty text has an empty array."""
    shared = sent(docs.sparkSession, model)
    names = list(keep)

    def run(batches):
        lattice = Lattice(shared())
        for b in batches:
            lo = 0
            for ids, off in lattice.encode(b.column(at)):
                n = len(off) - 1
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, n) for c in b.columns[: len(names)]), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32()))], [*names, "ids"])
                lo += n

    source, at, kinds = with_text(docs, keep, text)
    return source.mapInArrow(tidy(run), f"{kinds}, ids array<int>")


def decode_batch(column: pa.Array, raw: np.ndarray, at: np.ndarray, size: np.ndarray, dummy: bool) -> list[str]:
    off = column.offsets.to_numpy()
    ids = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64)
    off = off - off[0]
    n = size[ids]
    ends = np.concatenate([[0], np.cumsum(n)])
    flat = np.repeat(at[ids] - ends[:-1], n) + np.arange(ends[-1])
    data = raw[flat].tobytes()
    out = []
    for a, b in zip(ends[off[:-1]], ends[off[1:]]):
        x = data[a:b]
        out.append((x[1:] if dummy and x[:1] == b" " else x).decode("utf-8", "replace"))
    return out


def decode(encoded: DataFrame, model: PieceTable, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``'s columns with ``decoded``, the text of ``ids``; null ids decode to an empty text.

    A character U+2581 of the text comes back as a space, as both are one
    piece character.
    """
    raw = np.frombuffer(b"".join(model.raw), np.uint8)
    size = np.array([len(x) for x in model.raw], np.int64)
    shared = bound_batches(encoded.sparkSession).sparkContext.broadcast((raw, np.cumsum(size) - size, size, model.dummy_space))
    names = list(keep)

    def run(batches):
        raw, at, size, dummy = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids = part.column(part.num_columns - 1)
                text = decode_batch(ids, raw, at, size, dummy)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(text, pa.string())], [*names, "decoded"])

    source = encoded.select(*keep, F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids_of_it"))
    kinds = [f"`{c}` {t}" for c, t in source.select(*keep).dtypes]
    return source.mapInArrow(tidy(run), ", ".join([*kinds, "decoded string"]))
