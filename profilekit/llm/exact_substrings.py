"""Removal of every byte covered by a string of ``WINDOW`` bytes that also starts earlier in the corpus.

Order is by doc_id, then by start. Each window belongs to the smallest hash of the ``ANCHOR``-byte strings in it (the
leftmost on ties), which equal windows share. Neighbouring windows with one anchor form a piece of under
2 * ``WINDOW`` bytes. Pieces meet by anchor in buckets: of equal pieces the first keeps its bytes, and all others lose
theirs. A task settles this among its own rows before the shuffle and sends one piece of each kind, so the copies of a
frequent passage never meet in one place. Anchors with very many different pieces (``crowded``: a frequent line in varied
surroundings) are split: each window of theirs is a piece, dealt by its own hash. Where another anchor has different pieces (where copies begin or end), one of
each kind is fetched as text; windows without an equal in the bucket are dropped, and the rest are ordered by a suffix
array (``suffixes``): neighbours with ``WINDOW`` bytes in common are equal windows, and all but the first go.

Hashes only deal out the work, but for whole pieces, which count as equal if 108 bits agree. Which anchors are split
is read from a share of the rows; it says where windows meet, and whether they do so as pieces, but not what is removed.

Defined cases: null text is empty; texts shorter than ``WINDOW`` lose nothing; rows without doc_id lose and cause
nothing; rows that repeat a doc_id are read as one document (equal rows get equal results; otherwise all
intervals found for the id apply, within each text); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import id_and_text, materialize, mix64, pieces, texts_as_bytes
from profilekit.llm.suffixes import suffix_array

WINDOW, ANCHOR = 100, 32
_CHUNK, _FLUSH, _BUCKET_BYTES = 1 << 19, 12 << 20, 4 << 20
#: One in ``SHARE`` rows is read for crowded anchors; those with over ``CROWD`` kinds of pieces there count as such, if they
#: also have over one in ``SPLIT`` of all kinds of such anchors, which bounds the list that every task gets.
SHARE, CROWD, SPLIT = 16, 512, 1 << 20
_SEED = np.dtype([("h", "<u8"), ("piece", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "u1"), ("dup", "u1")])


def buckets_for(docs: DataFrame) -> int:
    """Buckets by the size of the input, so that one bucket's seeds stay in memory at any size."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(1 << 30, max(16, size // _BUCKET_BYTES))


def _eight(a: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    return x


def seeds(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first window, windows) of all pieces, chunk by chunk; windows of one piece have one anchor."""
    whole = np.frombuffer(text, np.uint8)
    for base in range(0, len(whole) - WINDOW + 1, _CHUNK):
        x = _eight(whole[base : base + _CHUNK + WINDOW - 1])
        with np.errstate(over="ignore"):
            k = len(x) - (ANCHOR - 8)
            h = x[:k] * np.uint64(0x9E3779B97F4A7C15)
            for at, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
                h ^= h >> np.uint64(32)
                h += x[at : at + k] * np.uint64(odd)
                h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(33)
        m = (h & ~np.uint64(0xFFFFF)) | np.arange(k, dtype=np.uint64)
        span, width = 1, WINDOW - ANCHOR + 1
        while 2 * span <= width:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < width:
            m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
        first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        yield m[first] >> np.uint64(20), first + base, np.diff(np.append(first, len(m)))


def _rows(doc: int, text: bytes) -> Iterator[np.ndarray]:
    digest = xxhash.xxh3_64_intdigest
    for h, first, n in seeds(text):
        rows = np.zeros(len(h), _SEED)
        rows["h"], rows["doc"], rows["start"], rows["n"] = h, doc, first, n
        rows["piece"] = [digest(text[a:b]) for a, b in zip(first.tolist(), (first + n + WINDOW - 1).tolist(), strict=True)]
        yield rows


def crowded(docs: DataFrame) -> np.ndarray:
    """Sorted anchors that are split, fewer than ``SPLIT``: a share of the rows that grows with the table is read, so that
    of any other anchor about ``SHARE`` * ``CROWD`` kinds of pieces meet, or one in ``SPLIT`` of those that are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            found = [rows for text in texts_as_bytes(batch) for rows in _rows(0, text or b"")]
            if found:
                kinds = np.unique(np.concatenate(found)[["h", "piece"]])
                yield pa.RecordBatch.from_arrays([pa.array(kinds[c].astype(np.int64)) for c in ("h", "piece")], ["h", "piece"])

    share = id_and_text(docs).where("doc_id is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0)
    kinds = share.mapInArrow(run, "h long, piece long").distinct().groupBy("h").agg(F.count("*").alias("n"))
    many = materialize(kinds.where(F.col("n") > CROWD))
    total = many.agg(F.sum("n")).first()[0] or 0
    return np.sort(many.where(F.col("n") > total / SPLIT).select("h").toArrow()["h"].to_numpy()).view(np.uint64)


def split(rows: np.ndarray, text: bytes, anchors: np.ndarray) -> np.ndarray:
    """``rows`` of one text, with each window of an anchor in ``anchors`` as a piece under a hash of its own."""
    if not len(anchors):
        return rows
    hot = anchors[np.minimum(np.searchsorted(anchors, rows["h"]), len(anchors) - 1)] == rows["h"]
    if not hot.any():
        return rows
    apart = np.repeat(rows[hot], rows["n"][hot])
    which = np.repeat(np.cumsum(rows["n"][hot], dtype=np.int64) - rows["n"][hot], rows["n"][hot])
    apart["start"] += (np.arange(len(apart)) - which).astype(np.int32)
    apart["n"] = 1
    windows = [text[a : a + WINDOW] for a in apart["start"].tolist()]
    apart["h"] = [xxhash.xxh3_64_intdigest(w, 1) for w in windows]
    apart["piece"] = [xxhash.xxh3_64_intdigest(w) for w in windows]
    return np.concatenate([rows[~hot], apart])


def _settle(rows: np.ndarray) -> np.ndarray:
    """Sorted by anchor, piece and place, with all but the first of each piece marked; a place that is read twice counts once."""
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["piece"], rows["h"]))]
    if len(rows) > 1:
        rows = rows[np.concatenate([[True], rows[["h", "piece", "doc", "start"]][1:] != rows[["h", "piece", "doc", "start"]][:-1]])]
        same = (rows["h"][1:] == rows["h"][:-1]) & (rows["piece"][1:] == rows["piece"][:-1])
        rows["dup"][1:][same] = 1
    return rows


def _deal(docs: DataFrame, buckets: int, anchors: np.ndarray) -> DataFrame:
    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = _settle(np.concatenate(held))
        lot = np.where(rows["dup"] == 1, mix64(rows["doc"].view(np.uint64)), mix64(rows["h"])) % np.uint64(buckets)
        order = np.argsort(lot, kind="stable")
        lot, rows = lot[order], rows[order]
        cut = np.flatnonzero(np.concatenate([[True], lot[1:] != lot[:-1]]))
        blobs = [rows[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(rows)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(lot[cut].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in pieces(batches, 256):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_as_bytes(batch), strict=True):
                if text is None or len(text) < WINDOW:
                    continue
                for rows in _rows(doc, text):
                    held.append(split(rows, text, anchors))
                total += len(text)
                if total >= _FLUSH:
                    yield flush(held)
                    held, total = [], 0
        if held:
            yield flush(held)

    return id_and_text(docs).where("doc_id is not null").mapInArrow(run, "bucket int, blob binary")


def _meet(table: pa.Table) -> pa.Table:
    """Intervals of copies (h null), and one of each kind of piece where an anchor has several (h set)."""
    rows = np.frombuffer(b"".join(table.column("blob").to_pylist()), _SEED).copy()
    known, rows = rows[rows["dup"] == 1], _settle(rows[rows["dup"] == 0])
    kinds = rows[rows["dup"] == 0]
    again = np.zeros(len(kinds), bool)
    if len(kinds) > 1:
        same = kinds["h"][1:] == kinds["h"][:-1]
        again[1:] |= same
        again[:-1] |= same
    ask, gone = kinds[again], np.concatenate([known, rows[rows["dup"] == 1]])
    both = np.concatenate([gone, ask])
    h = pa.array(both["h"].astype(np.int64), mask=np.arange(len(both)) < len(gone))
    return pa.table({"doc_id": both["doc"], "h": h, "first": both["start"].astype(np.int64), "n": both["n"].astype(np.int32)})


def _fetch(asked: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    by_doc = asked.groupBy("doc_id").agg(F.collect_list(F.struct("h", "first", "n")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            doc, h, first, text = [], [], [], []
            for d, t, want in zip(batch.column("doc_id").to_pylist(), texts_as_bytes(batch), batch.column("want").to_pylist(), strict=True):
                for w in want:
                    part = (t or b"")[w["first"] : w["first"] + w["n"] + WINDOW - 1]
                    if len(part) >= WINDOW:
                        doc.append(d)
                        h.append(w["h"])
                        first.append(w["first"])
                        text.append(part)
            lot = (mix64(np.array(h, np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(lot), pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(text, pa.binary())], ["bucket", "doc_id", "first", "part"])

    return id_and_text(docs).join(by_doc, "doc_id").mapInArrow(run, "bucket int, doc_id long, first long, part binary")


def covered(parts: list[bytes], docs: list[int], firsts: list[int]) -> list[tuple[int, int, int]]:
    """(doc, first, end) of the windows in ``parts`` that an earlier place has too."""
    lengths = np.array([len(p) for p in parts])
    width = int(lengths.max(initial=0))
    if width < WINDOW:
        return []
    hashes = np.zeros((len(parts), width - WINDOW + 1), np.uint64)
    cells = np.zeros((len(parts), width), np.uint64)
    for k, p in enumerate(parts):
        cells[k, : len(p)] = np.frombuffer(p, np.uint8)
    with np.errstate(over="ignore"):
        factor, power = np.uint64(0x9E3779B97F4A7C15), np.ones(width, np.uint64)
        power[1:] = np.cumprod(np.full(width - 1, factor))
        sums = np.concatenate([np.zeros((len(parts), 1), np.uint64), np.cumsum((cells + np.uint64(1)) * power[::-1], axis=1, dtype=np.uint64)], axis=1)
        hashes = (sums[:, WINDOW:] - sums[:, :-WINDOW]) * power[: width - WINDOW + 1]
    real = np.arange(width - WINDOW + 1)[None] <= (lengths - WINDOW)[:, None]
    values, which, counts = np.unique(hashes[real], return_inverse=True, return_counts=True)
    shared = np.zeros(real.shape, bool)
    shared[real] = counts[which] > 1
    out, kept, rows = [], {}, {}
    for k in np.flatnonzero(shared.any(axis=1)).tolist():  # runs of windows that have an equal, each kind of text once
        hit = np.flatnonzero(np.diff(np.concatenate([[0], shared[k].astype(np.int8), [0]]))).reshape(-1, 2)
        for a, b in hit.tolist():
            text, place = parts[k][a : b + WINDOW - 1], (docs[k], firsts[k] + a)
            other = kept.get(text)
            if other == place:
                continue
            if other is None or place < other:
                kept[text], other = place, other
                rows[text] = (k, a, b)
            else:
                other = place
            if other is not None:
                out.append((other[0], other[1], other[1] + len(text)))
    if len(kept) < 2:
        return out
    marks = [hashes[row, a:b] for row, a, b in rows.values()]
    _, which, counts = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
    many = counts[which] > 1
    ends = np.cumsum([len(m) for m in marks])
    joined, origin = [], []
    for (text, (doc, first)), stop, n in zip(kept.items(), ends.tolist(), map(len, marks), strict=True):
        hit = np.flatnonzero(many[stop - n : stop])  # only texts, and parts of them, that share windows with others
        if len(hit):
            a, b = int(hit[0]), int(hit[-1]) + WINDOW
            joined += [x + 1 for x in text[a:b]] + [0]
            origin += [(doc, first + i) if i + WINDOW <= b else None for i in range(a, b + 1)]
    if not joined:
        return out
    joined[-1] = -1
    flat, run = bytes(max(0, x - 1) for x in joined), []

    def close() -> None:
        first = min(run)
        out.extend((d, s, s + WINDOW) for d, s in run if (d, s) != first)

    last = None
    for s in suffix_array(joined):
        if origin[s] is None:
            continue
        text = flat[s : s + WINDOW]
        if text != last and run:
            close()
            run = []
        last = text
        run.append(origin[s])
    if run:
        close()
    return out


def _order(table: pa.Table) -> pa.Table:
    found = covered(table.column("part").to_pylist(), table.column("doc_id").to_pylist(), table.column("first").to_pylist())
    doc, first, end = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "first": pa.array(first, pa.int64()), "end": pa.array(end, pa.int64())})


def intervals(docs: DataFrame) -> DataFrame:
    """doc_id, first, end of byte ranges to be removed; they may overlap."""
    buckets = buckets_for(docs)
    met = materialize(_deal(docs, buckets, crowded(docs)).groupBy("bucket").applyInArrow(_meet, "doc_id long, h long, first long, n int"))
    copies = met.where("h is null").select("doc_id", "first", (F.col("first") + F.col("n") + (WINDOW - 1)).alias("end"))
    parts = _fetch(met.where("h is not null"), docs, buckets)
    return copies.union(parts.groupBy("bucket").applyInArrow(_order, "doc_id long, first long, end long"))


def keep_mask(n: int, spans: list[dict] | None) -> np.ndarray:
    cover = np.zeros(n + 1, np.int32)
    if spans:
        np.add.at(cover, np.minimum([s["first"] for s in spans], n), 1)
        np.add.at(cover, np.minimum([s["end"] for s in spans], n), -1)
    return np.cumsum(cover)[:n] == 0


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    return id_and_text(docs).join(by_doc, "doc_id", "left")


def op1(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            rows = []
            for text, spans in zip(texts_as_bytes(batch), batch.column("spans").to_pylist(), strict=True):
                data = np.frombuffer(text or b"", np.uint8)
                keep = keep_mask(len(data), spans)
                gone = np.concatenate([[False], ~keep])
                rows.append((len(data), int((~keep).sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(data[keep].tobytes()).hexdigest()))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs, intervals(docs)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
