"""Best-fit packing of tokenised documents into sequences of at most ``CAPACITY`` tokens.

Only documents longer than a sequence are cut. Lengths are at most ``CAPACITY``, so their histogram has a fixed
size whatever the number of documents, and the whole plan is made on it: lengths over ``CAPACITY // SMALL`` are
put in ``GROUPS`` groups of equal cardinality and rounded up to the largest of their group (linear grouping); the
configuration problem over these few sizes is solved by column generation, to within ``NEAR`` of its bound; actual lengths
take the places of the rounded ones, longest first, but for the smallest place of each configuration of several; what is
left over, and all small documents, go best-fit, longest first, into the remaining room, so that the room that rounding
left is used as well. The plan lists runs of equal sequences. Pieces find their place by their rank among pieces of one length,
which is counted in salted parts, more for a frequent length, so that none is one task's work.

Ids are those of the library as the file sets it up: literals of special tokens become special tokens.

Defined cases: a null or empty text is the single id 0; repeated rows are packed each; null ids are packed
like others; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import string
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilekit.llm.common import LONGEST_KEY, Recent, hold, id_and_text, materialize, pieces

CAPACITY, END, GROUPS, SMALL, NEAR = 2048, 0, 64, 3, 1e-4
#: Fixed value: how the vocabulary marks a token that ends a pre-token.
WORD_END = "</w>"
#: Words of which each half of the cache remembers the ids: about 40 MB a half.
KNOWN = 250_000
#: Parts in which the pieces of one length are ranked: one for so many pieces up to ``SALTS`` parts, and one for every ``PART`` pieces at least.
SPREAD, SALTS, PART = 128, 256, 1 << 20
#: Characters on which lower-casing one by one, canonical composition and white space are plain, so that a text can be
#: tokenised word by word; any other text, and one with the literal of a special token, goes to the library whole.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-¬®-įı-ſ–—‘-”…]")


class WordTokens:
    """Packed ids of texts, word by word where that gives the library's ids; words used of late are remembered."""

    def __init__(self, path: str, known: int = KNOWN):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._special = [x.content.lower() for x in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._words = Recent(self._word, known)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Of a lower-case word with its punctuation."""
        core = word.rstrip(string.punctuation)
        if core.isalpha() and core != word:  # letters and what follows them are tokenised apart
            return self._words[core] + self._words[word[len(core) :]]
        return self.whole(word)

    def encode_packed(self, text: str) -> bytes:
        lower = text.lower()
        if _PLAIN.search(text) or any(x in lower for x in self._special):
            return self.whole(text)
        words = lower.split()
        self._learn(self._unknown(set(words)))
        return b"".join(map(self._words.__getitem__, words))

    def _unknown(self, some: set[str]) -> list[str]:
        return list(filterfalse(self._words.old.__contains__, filterfalse(self._words.__contains__, some)))

    def _learn(self, fresh: list[str]) -> None:
        """Words of letters alone are one pre-token each, so all that are new are encoded in one call and cut after word ends."""
        cores = {core for w in fresh if len(core := w.rstrip(string.punctuation)) <= LONGEST_KEY and core.isalpha()}
        cores = self._unknown(cores)
        if len(cores) > 1:
            ids = np.array(self.library.encode(" ".join(cores), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self._ends[ids]) + 1
            if len(stops) == len(cores):
                for core, a, b in zip(cores, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                    self._words.put(core, ids[a:b].tobytes())

    def clear(self) -> None:
        self._words.clear()


_LOADED: dict[tuple[str, int], WordTokens] = {}


def word_tokens(path: str, known: int = KNOWN) -> WordTokens:
    hold("packing", _LOADED.clear)
    if (path, known) not in _LOADED:
        _LOADED[path, known] = WordTokens(path, known)
    return _LOADED[path, known]


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, known: int = KNOWN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = word_tokens(path, known), np.array([END], "<u4").tobytes()
        for batch in pieces(batches, 512):
            at, starts, lengths, crcs = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = words.encode_packed(text or "") + last
                for start in range(0, len(ids), 4 * capacity):
                    piece = ids[start : start + 4 * capacity]
                    at.append(row)
                    starts.append(start // 4)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
            begin = np.array(starts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array((begin // capacity).astype(np.int32)), pa.array(begin), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _priced(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes of greatest worth that fits: its worth, and how often it has each size."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k, s in enumerate(sizes):
        if worth[k] > 0:
            for _ in range(capacity // s):
                other = best[:-s] + worth[k]
                better = other > best[s:] + 1e-12
                if not better.any():
                    break
                best[s:][better], choice[s:][better] = other[better], k
    column, room = np.zeros(len(sizes)), int(best.argmax())
    while room >= 0 and choice[room] >= 0:
        column[choice[room]] += 1
        room -= sizes[choice[room]]
    return float(column @ worth), column


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Multisets of sizes that fill sequences, with whole multiplicities within the demand: the configuration
    linear programme by column generation (revised simplex, unbounded knapsack as pricing), rounded down."""
    n = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    inverse, need = np.diag(1 / np.diag(basis)), np.array(demand, float)
    for step in range(60 * n):
        worth, column = _priced(sizes, inverse.sum(axis=0), capacity)
        if worth <= 1 + NEAR:
            break
        enters, has = inverse @ column, inverse @ need
        ratio = np.where(enters > 1e-9, has / np.where(enters > 1e-9, enters, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / enters[out]
            inverse = inverse - enters[:, None] * row[None]
            inverse[out] = row
    amounts, left, found = np.linalg.inv(basis) @ need, list(demand), []
    for k in np.argsort(-amounts):
        column = [int(round(x)) for x in basis[:, k]]
        times = min([max(0, int(amounts[k] + 1e-6)), *(left[i] // c for i, c in enumerate(column) if c)])
        if times:
            found.append((column, times))
            left = [x - c * times for x, c in zip(left, column, strict=True)]
    return found


class Plan:
    """Rows (length, first rank, end rank, first sequence, copies a sequence, offset) for a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity, self.groups, self.rows, self.sequences = capacity, groups, [], 0
        self._left = {k: v for k, v in sorted(histogram.items(), reverse=True) if v}
        self._taken = dict.fromkeys(self._left, 0)
        self._room: dict[int, list[list[int]]] = {}
        self._rooms: list[int] = []
        if full := self._left.pop(capacity, 0):
            self._left[capacity] = full
            self._put(capacity, full, self._open(full), 1, 0)
        self._large()
        for length in list(self._left):
            while self._left.get(length):
                self._best_fit(length)

    def _open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def _put(self, length: int, items: int, first: int, per: int, offset: int) -> None:
        rank = self._taken[length]
        self.rows.append((length, rank, rank + items, first, per, offset))
        self._taken[length] = rank + items
        self._left[length] -= items
        if not self._left[length]:
            del self._left[length]

    def _keep(self, room: int, first: int, count: int) -> None:
        if room and count:
            if room not in self._room:
                self._room[room] = []
                bisect.insort(self._rooms, room)
            self._room[room].append([first, count])

    def _large(self) -> None:
        lengths = [k for k in self._left if self.capacity // SMALL < k < self.capacity]
        total = sum(self._left[k] for k in lengths)
        if not total:
            return
        share, groups, room = -(-total // self.groups), [], 0
        for k in lengths:
            n = self._left[k]
            while n:
                if not room:
                    groups.append([])
                    room = share
                take = min(n, room)
                groups[-1].append([k, take])
                n, room = n - take, room - take
        merged: list[list[list[int]]] = []
        for g in groups:
            if merged and merged[-1][0][0] == g[0][0]:
                merged[-1] += g
            else:
                merged.append(g)
        for column, times in configurations([g[0][0] for g in merged], [sum(x[1] for x in g) for g in merged], self.capacity):
            if sum(column) > 1:
                last = max(k for k, c in enumerate(column) if c)
                column = [c - (k == last) for k, c in enumerate(column)]
            used = [(merged[k], c) for k, c in enumerate(column) if c]
            while times:
                equal = min(g[0][1] // c for g, c in used)
                count = min(times, equal) or 1
                first, offset = self._open(count), 0
                for g, c in used:
                    need = c
                    while need:
                        per = min(need, g[0][1] // count)
                        self._put(g[0][0], per * count, first, per, offset)
                        offset, need = offset + per * g[0][0], need - per
                        g[0][1] -= per * count
                        if not g[0][1]:
                            g.pop(0)
                self._keep(self.capacity - offset, first, count)
                times -= count

    def _best_fit(self, length: int) -> None:
        n, at = self._left[length], bisect.bisect_left(self._rooms, length)
        if at == len(self._rooms):
            per = self.capacity // length
            first = self._open(count := -(-n // per))
            self._keep(self.capacity, first, count)
            at = bisect.bisect_left(self._rooms, length)
        room = self._rooms[at]
        first, count = self._room[room].pop()
        if not self._room[room]:
            del self._room[room]
            self._rooms.pop(at)
        per = min(room // length, n)
        take = min(count, n // per)
        self._put(length, per * take, first, per, self.capacity - room)
        self._keep(room - per * length, first, take)
        self._keep(room, first + take, count - take)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, known: int = KNOWN) -> DataFrame:
    """The pieces of ``docs`` and their places; ``known`` words have their ids remembered, which costs memory and saves time."""
    spread = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()).alias("spread")  # written, so that it stays as it is
    cuts = materialize(cut(docs, path, capacity, known).select("*", spread))
    counted, sizes = cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toArrow(), np.zeros(capacity + 1, np.int64)  # at most capacity rows
    sizes[counted["length"].to_numpy()] = counted["n"].to_numpy()
    parts = np.maximum(np.minimum(-(-sizes // SPREAD), SALTS), -(-sizes // PART))
    base = np.cumsum(parts) - parts
    many = F.element_at(F.array(*map(F.lit, np.maximum(parts, 1).tolist())), F.col("length").cast("int") + 1)
    cuts = cuts.withColumn("salt", F.pmod("spread", many))
    per = cuts.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most capacity * SALTS rows and one for every PART pieces
    table = np.zeros(int(parts.sum()), np.int64)
    table[base[per["length"].to_numpy()] + per["salt"].to_numpy()] = per["n"].to_numpy()
    before = np.cumsum(table) - table
    before -= np.repeat(np.cumsum(sizes) - sizes, parts)
    rows = np.array(sorted(Plan(dict(enumerate(sizes.tolist())), capacity).rows), np.int64).reshape(-1, 6)
    keys = (rows[:, 0] << 44) + rows[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt, nth = (batch.column(c).to_numpy() for c in ("length", "salt", "nth"))
            rank = before[base[length] + salt] + nth - 1
            r = rows[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            step, copy = np.divmod(rank - r[:, 1], r[:, 4])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(r[:, 3] + step), pa.array(r[:, 5] + copy * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "spread"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return cuts.select(*names, "salt", nth.alias("nth")).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


op6 = pack
