"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The merges are compiled by their known local property: a sequence of tokens is the encoding of its bytes exactly if
every two neighbours, encoded together, give themselves. While bytes of a pre-token come in, the transducer keeps
the last committed token and the bytes after it. A boundary is alive if what follows it begins some token; when all
living boundaries share their first tokens, these are emitted. A state depends on the committed token and pending
bytes alone, so states and their transitions are made once and then cost one look-up a byte. They are made when they
are met for the second time: at the first, the rest of that pre-token is followed by the same rules without making
states, since most rare words come once. Where ``MAX_STATES`` are reached, all but the present one are forgotten and made
again as they are needed, so that memory is bounded and the transducer goes on. A state whose pending bytes pass
``LOOKAHEAD`` is not made: the rest of that pre-token (a very long run of one pattern) is followed in the same way.

Ids are decoded in blocks of ``BLOCK``: their bytes go through an incremental UTF-8 machine, which holds back an unfinished character.

Defined cases: null text is empty (no tokens); the empty text has no ids; repeated rows are all encoded; null
ids are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from profilekit.llm.common import Recent, hold, id_and_text, pieces

LOOKAHEAD, MAX_STATES, BLOCK = 192, 300_000, 4096
#: Whole pre-tokens of which each half of the cache remembers the ids.
_KNOWN = 400_000
#: Pairs of tokens of which it is remembered whether they may stand side by side.
_PAIRS = 1 << 17
#: Transitions of which it is remembered that they were met once.
_MET = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 32) -> list[int]:
    """Ids of one pre-token by merging the lowest rank first, leftmost on ties, ranks under ``below`` only; O(n log n)."""
    n = len(piece)
    if n == 0:
        return []
    end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2], below)) < below]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(piece[i : end[nxt[i]]], below)) < below:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if (p := prv[i]) >= 0 and (r := ranks.get(piece[p:stop], below)) < below:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class Transducer:
    """Encodes pre-tokens to packed little-endian 32-bit ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._begins = {t[:k] for t in ranks for k in range(1, len(t))}
        self._halves: dict[int, tuple[int, int]] = {}
        self._whole: dict[tuple[int, int], int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            parts = merge(token, ranks, i) if len(token) > 1 else [i]
            self._halves[i] = (parts[0], parts[1]) if len(parts) == 2 else (i, i)
            if len(parts) == 2:
                self._whole[parts[0], parts[1]] = i
        self.past = self.flushes = 0
        self._side_by_side: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        #: For each state: the committed token, the bytes after it, the living boundaries among them (ascending), and for
        #: each boundary the token that ends there, where that token starts, and where the first token on the way to it ends.
        self._states: list[tuple[int, bytes, list[int], dict[int, tuple[int, int, int]]]] = [(-1, b"", [0], {})]
        self._ids: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self._moves: dict[int, tuple[int, bytes]] = {}
        self._once: set[int] = set()
        self._finals: dict[int, bytes] = {0: b""}

    def _forget(self, state: int) -> int:
        """The new number of ``state``, once it and the first are the only ones."""
        kept = self._states[state]
        self._reset()
        self.flushes += 1
        if state:
            self._states.append(kept)
            self._ids[kept[:2]] = 1
        return min(state, 1)

    def _fits(self, left: int, right: int) -> bool:
        """Whether both, encoded together, give themselves: no earlier merge reaches over the boundary.

        The parts next to the boundary are undone from the latest merge on; a merge of two that meet there must
        not come before the merges that still stand.
        """
        if left < 0:
            return True
        known = self._side_by_side.get(left << 32 | right)
        if known is None:
            if len(self._side_by_side) >= _PAIRS:
                self._side_by_side.clear()
            known = self._side_by_side[left << 32 | right] = self._undone(left, right)
        return known

    def _undone(self, left: int, right: int) -> bool:
        bound, halves, whole = 1 << 32, self._halves, self._whole
        while True:
            if whole.get((left, right), bound) < bound:
                return False
            for side in (0, 1) if left > right else (1, 0):
                if side == 0:
                    bound, left = left, halves[left][1]
                    if left != bound:
                        break
                else:
                    bound, right = right + 1, halves[right][0]
                    if right + 1 != bound:
                        break
            else:
                return True

    def _move(self, state: int, byte: int) -> tuple[int, bytes] | None:
        last, pending, living, cells = self._states[state]
        pending += bytes((byte,))
        n = len(pending)
        if n > LOOKAHEAD:
            return None
        alive, here = [], None
        for p in living:
            begun = pending[p:]
            if here is None:
                token = self.ranks.get(begun)
                if token is not None and self._fits(cells[p][0] if p else last, token):
                    here = (token, p, cells[p][2] if p else n)
            if begun in self._begins:
                alive.append(p)
        if here is not None:
            cells = {**cells, n: here}
            alive.append(n)
        emitted = b""
        while alive[0] and all(cells[p][2] == cells[alive[0]][2] for p in alive):
            base = cells[alive[0]][2]
            last, pending, alive = cells[base][0], pending[base:], [p - base for p in alive]
            emitted += last.to_bytes(4, "little")
            further: dict[int, tuple[int, int, int]] = {}
            for x, (token, p, _) in cells.items():
                if p == base or p - base in further:
                    further[x - base] = (token, p - base, x - base if p == base else further[p - base][2])
            cells = further
        key = (last, pending)
        to = self._ids.get(key)
        if to is None:
            to = self._ids[key] = len(self._states)
            self._states.append((last, pending, alive, cells))
        move = self._moves[state << 8 | byte] = (to, emitted)
        return move

    def _final(self, state: int) -> bytes:
        _, pending, _, cells = self._states[state]
        at, out = len(pending), b""
        while at:
            token, at, _ = cells[at]
            out = token.to_bytes(4, "little") + out
        self._finals[state] = out
        return out

    def _simulated(self, state: int, rest: bytes) -> bytes:
        """Ids of what is pending in ``state`` and ``rest`` up to its end: the same boundaries and cells, without making states."""
        last, pending, living, cells = self._states[state]
        ranks, begins, known, fits = self.ranks, self._begins, self._side_by_side, self._fits
        text, ends = pending + rest, {x: c[:2] for x, c in cells.items()}
        for n in range(len(pending) + 1, len(text) + 1):
            alive, here = [], None
            for p in living:
                begun = text[p:n]
                if here is None and (token := ranks.get(begun)) is not None:
                    left = ends[p][0] if p else last
                    can = known.get(left << 32 | token)
                    if fits(left, token) if can is None else can:
                        here = (token, p)
                if begun in begins:
                    alive.append(p)
            if here is not None:
                ends[n] = here
                alive.append(n)
            living = alive
        at, out = len(text), []
        while at:
            token, at = ends[at]
            out.append(token.to_bytes(4, "little"))
        return b"".join(out[::-1])

    def encode(self, piece: bytes) -> bytes:
        state, out, moves = 0, [], self._moves
        for at, byte in enumerate(piece):
            move = moves.get(state << 8 | byte)
            if move is None:
                if (key := state << 8 | byte) not in self._once:
                    if len(self._once) >= _MET:
                        self._once.clear()
                    self._once.add(key)
                    out.append(self._simulated(state, piece[at:]))
                    return b"".join(out)
                if len(self._states) >= MAX_STATES:
                    state = self._forget(state)
                    moves = self._moves
                move = self._move(state, byte)
                if move is None:
                    self.past += 1
                    out.append(self._simulated(state, piece[at:]))
                    return b"".join(out)
            state = move[0]
            if move[1]:
                out.append(move[1])
        last = self._finals.get(state)
        if last is None:
            last = self._final(state)
        out.append(last)
        return b"".join(out)


class Codec:
    """Text to packed ids and back, each match of ``pattern`` on its own, without special tokens."""

    def __init__(self, path: str, pattern: str):
        self.machine = Transducer(read_ranks(path))
        self._find = regex.compile(pattern).findall
        self._cache = Recent(lambda piece: self.machine.encode(piece.encode("utf-8")), _KNOWN)
        self._vocab = self.machine.bytes_of

    def encode_packed(self, text: str) -> bytes:
        return b"".join(map(self._cache.__getitem__, self._find(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self._vocab.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], block: int = 1) -> Iterator[str]:
        """Text as ids come in, ``block`` at a time; bytes of an unfinished character wait for the next ids."""
        state, ids = Utf8(), iter(ids)
        while some := list(islice(ids, block)):
            if out := state.feed(b"".join(map(self._vocab.__getitem__, some))):
                yield out
        if out := state.close():
            yield out


class Utf8:
    """Incremental UTF-8: states by how many continuation bytes are due and the range the next must be in."""

    def __init__(self) -> None:
        self._held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Length of the tail of ``data`` that may still become a character."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            due = 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0
            if due < back:
                return 0
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
            return back if back == 1 or low <= data[-back + 1] <= high else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self._held + data
        n = len(data) - self._unfinished(data)
        self._held = data[n:]
        return data[:n].decode("utf-8", "replace")

    def close(self) -> str:
        out, self._held = self._held.decode("utf-8", "replace"), b""
        return out


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without garbage collection, which would go through all states again and again; they hold no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a process, so that its tables serve all tasks of a worker."""
    hold("bpe", _CODECS.clear)
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: for uses that want the tokens themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in pieces(batches, 256):
            with _uncollected():
                ids = [np.frombuffer(c.encode_packed(t or ""), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def op4(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path, pattern), hashlib.sha256
        for batch in pieces(batches, 256):
            rows: list[tuple[int, str, str]] = []
            for text in batch.column("text").to_pylist():
                with _uncollected():
                    packed = c.encode_packed(text or "")
                back = sha()
                for part in c.decode_stream(np.frombuffer(packed, "<u4").tolist(), BLOCK):
                    back.update(part.encode("utf-8"))
                rows.append((len(packed) // 4, sha(packed).hexdigest(), back.hexdigest()))
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
