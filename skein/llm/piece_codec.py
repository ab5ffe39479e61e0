"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Each word (a space mark and the run up to the next one) is segmented by the
agenda of BPE: the candidate merge of best score, leftmost first, is taken,
unless its keyed hash says to skip it.  A skipped candidate is dropped for
good; later merges next to it make new candidates.  The key holds the seed, the
document id, the word, its place in the text and the candidate's place in it, so
each occurrence is dropped for itself and results don't depend on order,
partitions or retries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectext import column, mix, pieces, run_hashes, spread

MARK = "▁"
#: Bytes of text whose words are segmented together.
BATCH_BYTES = 1 << 21
#: Words above which a worker's cache starts anew.
CACHE = 500_000
#: Words of up to these many code points are segmented together, so many at once.
WIDTHS, TOGETHER = (6, 9, 12, 18, 32, 64), 20_000
#: No merge; a free slot; a hash multiplier.
NONE, FREE, HASH = (1 << 31) - 1, -(1 << 62), 0x9E3779B97F4A7C15
#: The cache's key of a literal U+2581.
LITERAL = 0
#: Multipliers of a candidate's start, middle and end in its key, for runs of any length.
PLACES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


class PieceCodec:
    """Encoder and decoder for a SentencePiece BPE model with byte fallback,
    identity normalisation, a dummy prefix and pieces that keep within a word."""

    def __init__(self, path: str, dropout: float = 0.1, seed: int = 1, lanes: int = 2) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        self.dropout, self.seed, self.lanes = int(dropout * (1 << 32)), seed, lanes
        self.ids: dict[str, int] = {}
        self.rank: dict[str, tuple[int, int]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[p] = i
                self.rank[p] = (-sp.get_score(i), i)
                self.bytes_of.append(p.replace(MARK, " ").encode())
        self.byte_ids = np.array(self.byte_id, np.int32)
        self.order = {p: r for r, (p, _) in enumerate(sorted(self.rank.items(), key=lambda x: x[1]))}
        self.byte_len = np.array(list(map(len, self.bytes_of)), np.int64)
        self.byte_at = np.cumsum(self.byte_len) - self.byte_len
        self.byte_pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._index()
        self._forget()

    def _index(self) -> None:
        """Symbols are pieces and, above them, other characters by code point;
        an open-addressing table maps a pair of symbols to its merged piece."""
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        number = lambda p: self.ids[p] if p in self.ids else (self.size + ord(p) if len(p) == 1 else -1)
        pairs = {}
        for p in self.ids:
            for m in range(1, len(p)):
                a, b = number(p[:m]), number(p[m:])
                if a >= 0 and b >= 0:
                    pairs[a << 22 | b] = self.order[p]
        self.bits = max(10, (8 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.slot, self.slot_rank = np.full(size, FREE, np.int64), np.full(size, NONE, np.int32)
        self.piece_of_rank = np.zeros(len(self.order), np.int32)
        for p, r in self.order.items():
            self.piece_of_rank[r] = self.ids[p]
        for key, r in pairs.items():
            at = (key * HASH & (1 << 64) - 1) >> (64 - self.bits)
            while self.slot[at] != FREE:
                at = (at + 1) & (size - 1)
            self.slot[at], self.slot_rank[at] = key, r

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs of symbols; NONE: no merge, or an end (-1)."""
        key = a.astype(np.int64) << 22 | b
        at = ((key.astype(np.uint64) * np.uint64(HASH)) >> np.uint64(64 - self.bits)).astype(np.int64)
        seen = self.slot[at]
        far = np.flatnonzero((seen != key) & (seen != FREE))
        while len(far):
            at[far] = (at[far] + 1) & (len(self.slot) - 1)
            seen = self.slot[at[far]]
            far = far[(seen != key[far]) & (seen != FREE)]
        return np.where(self.slot[at] == key, self.slot_rank[at], NONE).astype(np.int32)

    def _skipped(self, key: np.ndarray, i: np.ndarray, m: np.ndarray, e: np.ndarray) -> np.ndarray:
        at = sum(x.astype(np.uint64) * np.uint64(p) for x, p in zip((i, m, e), PLACES, strict=True))
        h = (key ^ at) * np.uint64(HASH)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(32)) < np.uint64(self.dropout)

    def _keys(self, words: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        return mix(words + (lanes.astype(np.uint64) + np.uint64(1)) * np.uint64(HASH) + np.uint64(self.seed & (1 << 64) - 1) * np.uint64(0xD6E8FEB86659FD93))

    def _segment_many(self, points: np.ndarray, start: np.ndarray, length: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, ids end to end, ids a word) of words of at most
        ``width`` code points: all go through the agenda together, one merge a round."""
        n = len(start)
        col = np.arange(width + 2, dtype=np.int32)
        inside = col < length[:, None]
        sym = np.full((n, width + 2), -1, np.int32)
        sym[inside] = self.symbol[points[(start[:, None] + col)[inside]]]
        pos = np.minimum(np.broadcast_to(col, sym.shape), length[:, None]).astype(np.int32)
        rank = np.full((n, width + 2), NONE, np.int32)
        row = np.arange(n)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def look(rows: np.ndarray, j: np.ndarray) -> None:
            """Sets the candidate of symbols j and j + 1 of each row."""
            at = rows * (width + 2) + j
            flat, place = sym.ravel(), pos.ravel()
            r = self._pairs(flat[at], flat[at + 1])
            some = np.flatnonzero(r != NONE)
            if self.dropout and len(some):
                x = at[some]
                r[some[self._skipped(key[rows[some]], place[x], place[x + 1], place[x + 2])]] = NONE
            rank.ravel()[at] = r

        look(*np.nonzero(inside[:, 1 : width + 1]))
        while True:
            best = rank.argmin(1)
            every = np.arange(len(row))
            on = rank[every, best] != NONE
            if not on.all():
                done.append((row[~on], sym[~on]))
                row, sym, pos, rank, key, best = row[on], sym[on], pos[on], rank[on], key[on], best[on]
                every = every[: len(row)]
            if not len(row):
                break
            sym[every, best] = self.piece_of_rank[rank[every, best]]
            shift = col[:-1] > best[:, None]
            for x, last in ((sym, -1), (pos, None), (rank, NONE)):
                np.copyto(x[:, :-1], x[:, 1:].copy(), where=shift)
                if last is not None:
                    x[:, -1] = last
            look(every, best)
            more = np.flatnonzero(best)
            look(more, best[more] - 1)
        row, sym = np.concatenate([r for r, _ in done]), np.concatenate([x for _, x in done])
        held = sym >= 0
        flat, count = sym[held], held.sum(1)
        odd = np.flatnonzero(flat >= self.size)  # characters outside the vocabulary: their bytes
        if len(odd):
            own = np.repeat(np.arange(len(row)), count)
            data = [chr(x).encode() for x in (flat[odd] - self.size).tolist()]
            wide = np.ones(len(flat), np.int64)
            wide[odd] = list(map(len, data))
            count = np.bincount(own, weights=wide, minlength=len(row)).astype(np.int64)
            first = (np.cumsum(wide) - wide)[odd]
            flat = np.repeat(flat, wide)
            flat[spread(first, wide[odd])] = self.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
        return row, flat, count

    def _segment(self, word: str, key: int) -> tuple[int, ...]:
        """The agenda for one word, as a heap."""
        n = len(word)
        order = self.order
        right = list(range(1, n + 1))  # end of the symbol that starts here
        left = list(range(-1, n - 1))  # start of the symbol before
        agenda = []
        for i in range(n - 1):
            r = order.get(word[i : i + 2])
            if r is not None:
                agenda.append((r, i, i + 1, i + 2))
        if agenda:
            drop = self.dropout
            p1, p2, p3 = PLACES
            heapify(agenda)
            while agenda:
                _, i, m, e = heappop(agenda)
                if right[i] != m or m >= n or right[m] != e:
                    continue  # one of its symbols is gone
                if drop:
                    h = ((key ^ (i * p1 + m * p2 + e * p3 & 0xFFFFFFFFFFFFFFFF)) * HASH) & 0xFFFFFFFFFFFFFFFF
                    h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
                    if h >> 32 < drop:
                        continue
                right[i], right[m] = e, 0
                if e < n:
                    left[e] = i
                    f = right[e]
                    r = order.get(word[i:f])
                    if r is not None:
                        heappush(agenda, (r, i, e, f))
                b = left[i]
                if b >= 0:
                    r = order.get(word[b:e])
                    if r is not None:
                        heappush(agenda, (r, b, i, e))
        out, i, ids = [], 0, self.ids
        while i < n:
            e = right[i]
            x = ids.get(word[i:e])
            if x is None:  # a single character outside the vocabulary
                out.extend(self.byte_id[b] for b in word[i:e].encode())
            else:
                out.append(x)
            i = e
        return tuple(out)

    def encode_batch(self, texts: list[str], lanes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and their offsets.  A literal U+2581
        goes to its three byte pieces, so that decoding gives it back."""
        points = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le"), np.uint32)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        first = np.concatenate(([0], np.cumsum(size)))
        n = len(points)
        space, literal = points == 32, points == ord(MARK)
        points = np.where(space, np.uint32(ord(MARK)), points)
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins |= literal
        begins[1:] |= literal[:-1]
        begins[first[:-1]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)
        hashes = run_hashes(points, start, end)
        lane = np.repeat(np.array(lanes, np.int64), np.diff(np.searchsorted(start, first)))
        if self.dropout:
            place = (start - np.repeat(first[:-1], np.diff(np.searchsorted(start, first)))).astype(np.uint64)
            key = mix(self._keys(hashes, lane) + place * np.uint64(0x9FB21C651E98DF25))
        else:
            key = self._keys(hashes, np.zeros(len(start), np.int64))
        alone = literal[start]
        key[alone] = LITERAL
        if self.dropout:
            # Each occurrence has a key of its own: nothing to look up or to keep for the next batch.
            self._forget()
            slots = np.full(len(start), self.cache[LITERAL], np.int64)
            own = np.flatnonzero(~alone)
            slots[own] = self._learn(points, start[own], end[own], key[own])
        else:
            uniq, at, back = np.unique(key, return_index=True, return_inverse=True)
            if len(self.cache) > CACHE:
                self._forget()
            slots = np.array([self.cache.get(k, -1) for k in uniq.tolist()], np.int64)
            miss = np.flatnonzero(slots < 0)
            if len(miss):
                slots[miss] = self._learn(points, start[at[miss]], end[at[miss]], uniq[miss])
                self.cache.update(zip(uniq[miss].tolist(), slots[miss].tolist(), strict=True))
            slots = slots[back]
        held, offset = slots & 0xFFFFFF, slots >> 24
        out = self.pool[spread(offset, held)]
        done = np.concatenate(([0], np.cumsum(held)))[np.searchsorted(start, first)]
        empty = size == 1  # no text, no prefix
        if empty.any():
            keep = np.ones(len(out), bool)
            for i in np.flatnonzero(empty).tolist():
                keep[done[i] : done[i + 1]] = False
            gone = np.concatenate(([0], np.cumsum(~keep)))
            out, done = out[keep], done - gone[done]
        return out, done

    def _forget(self) -> None:
        self.pool, self.used = np.zeros(1 << 16, np.int32), 3
        self.pool[:3] = [self.byte_id[b] for b in MARK.encode()]
        #: Key of a word -> offset in the pool << 24 | ids.
        self.cache = {LITERAL: 3}

    def _learn(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Segments words, puts them in the pool and gives their slots."""
        size = end - start
        slots = np.zeros(len(size), np.int64)

        def put(which: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(flat)), np.int32)))
            self.pool[self.used : self.used + len(flat)] = flat
            slots[which] = (self.used + np.cumsum(count) - count) << 24 | count
            self.used += len(flat)

        kind = np.searchsorted(WIDTHS, size)
        for g, width in enumerate(WIDTHS):
            own = np.flatnonzero(kind == g)
            for i in range(0, len(own), TOGETHER):
                x = own[i : i + TOGETHER]
                row, flat, count = self._segment_many(points, start[x], size[x], key[x], width)
                put(x[row], flat, count)
        for i in np.flatnonzero(kind == len(WIDTHS)).tolist():
            ids = self._segment(points[start[i] : end[i]].tobytes().decode("utf-32-le"), int(key[i]))
            put(np.array([i]), np.array(ids, np.int32), np.array([len(ids)]))
        return slots

    def bytes_from(self, ids: np.ndarray) -> bytes:
        """The bytes of pieces, end to end."""
        return self.byte_pool[spread(self.byte_at[ids], self.byte_len[ids])].tobytes()

    def encode(self, text: str, lane: int = 0) -> list[int]:
        return self.encode_batch([text], [lane])[0].tolist()

    def decode(self, ids) -> str:
        """The text, without the dummy prefix."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data[1:].decode() if data[:1] == b" " else data.decode()


@lru_cache(maxsize=4)
def codec(path: str, dropout: float, seed: int, lanes: int) -> PieceCodec:
    return PieceCodec(path, dropout, seed, lanes)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """One row per input row: ``id_col``, ``ids`` (array of int), ``n_tokens``,
    ``lossless`` (decoding gives the text back, byte for byte).

    A null text has null ``ids``, 0 tokens and is lossless; an empty one has no
    ids.  Rows without id share a key.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, dropout, seed, 1)
        for batch in batches:
            raw, off = column(batch.column(1))
            null = batch.column(1).is_null().to_pylist()
            doc_ids = batch.column(0).to_pylist()
            for i, j in pieces(off, BATCH_BYTES):
                data, at = raw[off[i] : off[j]].tobytes(), (off[i : j + 1] - off[i]).tolist()
                lane = [0 if x is None else xxhash.xxh3_64_intdigest(str(x).encode(), seed) >> 1 for x in doc_ids[i:j]]
                ids, sizes = c.encode_batch([data[a:b].decode() for a, b in zip(at, at[1:], strict=False)], lane)
                span = np.concatenate(([0], np.cumsum(c.byte_len[ids])))[sizes].tolist()
                back = c.bytes_from(ids)
                same = [back[a + 1 : b] == data[x:y] for a, b, x, y in zip(span, span[1:], at, at[1:], strict=False)]
                gone = pa.array(null[i:j])
                lists = pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(ids), mask=gone)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(np.diff(sizes).astype(np.int64)), pa.array(same, pa.bool_())], names=["id", "ids", "n_tokens", "lossless"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, ids array<int>, n_tokens long, lossless boolean").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: ``id_col`` and ``text``.  Null ids give a null text, no ids an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, 0.0, 0, 1)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    src = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
