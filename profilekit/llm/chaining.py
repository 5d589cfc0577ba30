"""Fuzzy repeated passages by collinear chaining.

Seeds are runs of ``WORDS`` words, thinned to the smallest hash of every ``THIN`` neighbours, so that any run of
``WORDS + THIN - 1`` equal words holds a shared one. Each seed is linked to its first place in the corpus alone (first in
its task, and from there first of all), so links grow with seeds, not with their pairs. Since the first places of
neighbouring seeds may lie in different documents, runs of ``LONG`` words are seeds too, thinned so that any
``LONG + THIN_LONG - 1`` = ``PASSAGE + 1`` equal words hold one: it leads to a document that has the whole run, and counts as a link
at every ``STEP`` words, first and last included, so that it makes a chain by itself. Links from one document to one earlier document are chained: both positions rise, a link gains ``WORDS``, gaps cost ``GAP`` a word on either side, and
the best predecessor comes from a Fenwick tree of prefix maxima. Chains of at least ``LEAST_SPAN`` words are aligned
on the words themselves: between links word by word or, where lengths differ, by longest common subsequence, and past
the ends while matches outweigh mismatches; a chain of which under ``SIMILAR`` matches is cut into its longest parts of which
enough does. What is aligned with any earlier documents is put together: a passage of at
least ``PASSAGE`` words of which at least ``SIMILAR`` are matched is a repetition; it goes from the later document and
stays in the earlier ones.

Words are compared in lower case (A-Z). Order is by doc_id. Defined cases: null and empty texts have no passages; rows
without doc_id cause and lose nothing; rows that repeat a doc_id are read as one document and are not compared with
each other (spans apply within each text; where their texts differ, passages are compared with the first of them in order); a passage
that a document repeats is a repetition of its first place there, but for text that repeats itself after fewer than ``LONG``
words; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm import textstats
from profilekit.llm.common import hold, id_and_text, materialize, mix64, pieces, texts_as_bytes, unused
from profilekit.llm.exact_substrings import buckets_for, keep_mask

WORDS, THIN, GAP, LEAST_SPAN, PASSAGE, SIMILAR, MARGIN, DROP = 5, 4, 0.05, 20, 50, 0.8, 48, 8
LONG, THIN_LONG, STEP, SEAM = 32, 20, 9, 4
_FLUSH = 12 << 20
#: Cells of one table of common subsequences; beyond, its halves are worked on.
_CELLS = 1 << 16
_SEED = np.dtype([("h", "<u8"), ("doc", "<i8"), ("pos", "<i4")])
#: The last bit of a seed's hash says whether it is long.
_EVEN = ~np.uint64(1)
_LINK = np.dtype([("doc", "<i8"), ("pos", "<i4"), ("to", "<i8"), ("at", "<i4"), ("long", "?")])


def _thinned(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest hash of every ``width`` neighbours."""
    if not len(grams):
        return np.zeros(0, np.int64)
    m, span, width = grams, 1, min(width, len(grams))
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    chosen = np.zeros(len(grams), bool)
    for k in range(width):
        chosen[k : k + len(m)] |= grams[k : k + len(m)] == m
    return np.flatnonzero(chosen)


def _long_grams(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``LONG`` words: eight at a time, then four of those."""
    eight = textstats.rolling(h, 8)
    n = len(h) - LONG + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, LONG, 8):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + eight[k : k + n])
    return out


def seeds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of the thinned runs of words, short and long.

    A short run that occurs again in the text is one more seed with its number, so that in periodic text the n-th
    meets the n-th and links rise.
    """
    h = textstats.word_hashes(text.lower().split())
    short, long = textstats.rolling(h, WORDS), _long_grams(h)
    at, far = _thinned(short, THIN), _thinned(long, THIN_LONG)
    near = short[at]
    order = np.argsort(near, kind="stable")
    ranked = near[order]
    fresh = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(at) else at
    nth = np.zeros(len(at), np.uint64)
    nth[order] = np.arange(len(at)) - np.repeat(fresh, np.diff(np.append(fresh, len(at))))
    again = nth > 0
    with np.errstate(over="ignore"):
        numbered = mix64(near[again] + nth[again] * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate([near & _EVEN, numbered & _EVEN, long[far] | np.uint64(1)]), np.concatenate([at, at[again], far]).astype(np.int32)


def _first_places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each seed, and links of the others to it."""
    rows = rows[np.lexsort((rows["pos"], rows["doc"], rows["h"]))]
    head = np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]]) if len(rows) else np.zeros(0, bool)
    owner = rows[head][np.cumsum(head) - 1] if len(rows) else rows
    later = rows["doc"] != owner["doc"]
    if len(rows):  # in one document, what comes again at once is short-period text
        again = (rows["h"][1:] == rows["h"][:-1]) & (rows["doc"][1:] == rows["doc"][:-1]) & (rows["pos"][1:] - rows["pos"][:-1] >= LONG)
        later[1:] |= again & ~head[1:]
    links = np.zeros(int(later.sum()), _LINK)
    links["doc"], links["pos"], links["to"], links["at"] = rows["doc"][later], rows["pos"][later], owner["doc"][later], owner["pos"][later]
    links["long"] = rows["h"][later] & np.uint64(1)
    return rows[head], links


def _deal(docs: DataFrame, buckets: int) -> DataFrame:
    def blobs(rows: np.ndarray, lot: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        order = np.argsort(lot, kind="stable")
        lot, rows = lot[order], rows[order]
        cut = np.flatnonzero(np.concatenate([[True], lot[1:] != lot[:-1]])) if len(lot) else np.zeros(0, np.int64)
        return lot[cut].astype(np.int32), [rows[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(rows)), strict=False)]

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        firsts, links = _first_places(np.concatenate(held))
        a, seed = blobs(firsts, mix64(firsts["h"]) % np.uint64(buckets))
        b, link = blobs(links, mix64(links["doc"].view(np.uint64)) % np.uint64(buckets))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(seed + [None] * len(b), pa.binary()), pa.array([None] * len(a) + link, pa.binary())], ["bucket", "seeds", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("chaining")
        held, total = [], 0
        for batch in pieces(batches, 256):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_as_bytes(batch), strict=True):
                h, at = seeds(text or b"")
                if len(h):
                    rows = np.zeros(len(h), _SEED)
                    rows["h"], rows["doc"], rows["pos"] = h, doc, at
                    held.append(rows)
                    total += len(text)
                if total >= _FLUSH:
                    yield flush(held)
                    held, total = [], 0
        if held:
            yield flush(held)

    return id_and_text(docs).where("doc_id is not null").mapInArrow(run, "bucket int, seeds binary, links binary")


def _meet(table: pa.Table) -> pa.Table:
    seeds_, links = (b"".join(x for x in table.column(c).to_pylist() if x) for c in ("seeds", "links"))
    both = np.concatenate([np.frombuffer(links, _LINK), _first_places(np.frombuffer(seeds_, _SEED))[1]])
    return pa.table({"doc_id": both["doc"], "pos": both["pos"], "to_id": both["to"], "at": both["at"], "long": both["long"]})


def spread(links: np.ndarray) -> np.ndarray:
    """Rows of doc, to, pos, at, sorted and distinct, from those with a fifth column that says which are long."""
    long = links[links[:, 4] > 0, :4]
    steps = [long + np.array([0, 0, k, k]) for k in range(STEP, LONG - WORDS + 1, STEP)]
    rows = np.concatenate([links[:, :4], *steps])
    rows = rows[np.lexsort(rows.T[[3, 2, 1, 0]])]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])] if len(rows) else rows


def chain(pos: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Chains of links sorted by ``pos`` (numbers of links, in order), best first, none sharing a link."""
    n = len(pos)
    ranks = np.unique(at, return_inverse=True)[1] + 1
    size = int(ranks.max())
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    p, a, r = pos.tolist(), at.tolist(), ranks.tolist()
    i = 0
    while i < n:
        stop = i
        while stop < n and p[stop] == p[i]:  # equal positions do not precede each other
            best, k = (-np.inf, -1), r[stop] - 1
            while k > 0:
                if tree[k] > best:
                    best = tree[k]
                k -= k & -k
            gained = best[0] - GAP * (p[stop] + a[stop])
            score[stop], back[stop] = (WORDS + gained, best[1]) if gained > 0 else (float(WORDS), -1)
            stop += 1
        for j in range(i, stop):
            item, k = (score[j] + GAP * (p[j] + a[j]), j), r[j]
            while k <= size:
                if item > tree[k]:
                    tree[k] = item
                k += k & -k
        i = stop
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda x: -score[x]):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = back[j]
        if path:
            out.append(path[::-1])
    return out


def _chains(links: DataFrame) -> DataFrame:
    """doc_id, to_id, pos, at (links of one chain, as arrays)."""

    def emit(held: np.ndarray) -> Iterator[tuple]:
        cut = np.flatnonzero(np.concatenate([[True], (held[1:, :2] != held[:-1, :2]).any(axis=1)]))
        end = np.append(cut[1:], len(held))
        wide = held[end - 1, 2] - held[cut, 2] + WORDS >= LEAST_SPAN
        for a, b in zip(cut[wide].tolist(), end[wide].tolist(), strict=True):
            part = held[a:b]
            for path in chain(part[:, 2], part[:, 3]):
                pos, at = part[path, 2], part[path, 3]
                if pos[-1] - pos[0] + WORDS >= LEAST_SPAN:
                    yield int(part[0, 0]), int(part[0, 1]), pos.astype(np.int32), at.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)

        def table(rows: np.ndarray) -> pa.RecordBatch:
            doc, to, pos, at = zip(*found, strict=True) if (found := list(emit(spread(rows)))) else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(to, pa.int64()), pa.array(pos, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int32()))], ["doc_id", "to_id", "pos", "at"])

        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)])
            last = np.flatnonzero((held[:, :2] != held[-1, :2]).any(axis=1)) if len(held) else np.zeros(0)
            if len(last):
                done = int(last[-1]) + 1
                yield table(held[:done])
                held = held[done:]
        if len(held):
            yield table(held)

    dealt = links.select("doc_id", "to_id", "pos", "at", F.col("long").cast("int")).repartition("doc_id", "to_id").sortWithinPartitions("doc_id", "to_id")
    return dealt.mapInArrow(run, "doc_id long, to_id long, pos array<int>, at array<int>")


def _word_hash32(text: bytes | None) -> np.ndarray:
    return (textstats.word_hashes((text or b"").lower().split()) >> np.uint64(32)).astype(np.uint32)


def _with_slices(chains: DataFrame, docs: DataFrame) -> DataFrame:
    """Each chain with the hashed words of the earlier document around it, fetched once for equal ranges."""
    ranged = chains.withColumn("low", F.greatest(F.element_at("at", 1) - MARGIN, F.lit(0))).withColumn("high", F.element_at("at", -1) + WORDS + MARGIN)
    asked = ranged.select("to_id", "low", "high").distinct().groupBy("to_id").agg(F.collect_list(F.struct("low", "high")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            to, low, high, part = [], [], [], []
            for d, t, want in zip(batch.column("doc_id").to_pylist(), texts_as_bytes(batch), batch.column("want").to_pylist(), strict=True):
                h = _word_hash32(t)
                for w in want:
                    to.append(d)
                    low.append(w["low"])
                    high.append(w["high"])
                    part.append(h[w["low"] : w["high"]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(part, pa.binary())], ["to_id", "low", "high", "words"])

    rows = id_and_text(docs)
    if _repeats(docs):
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    slices = rows.join(asked, rows["doc_id"] == asked["to_id"]).select("doc_id", "text", "want").mapInArrow(run, "to_id long, low int, high int, words binary")
    return ranged.join(slices, ["to_id", "low", "high"])


def _repeats(docs: DataFrame) -> bool:
    return not docs.select(docs["doc_id"].alias("doc_id")).where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def _longest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with every beginning of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row


def _common(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in ``a`` of a longest common subsequence, or of the equal words where most are; linear memory at any length."""
    if len(a) == len(b) and len(a) and (a == b).mean() >= 0.5:
        return np.flatnonzero(a == b).tolist()
    return _subsequence(a, b)


def _subsequence(a: np.ndarray, b: np.ndarray) -> list[int]:
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if n > 1 and n * m > _CELLS:  # halves of ``a`` with the parts of ``b`` that go best with them
        half = n // 2
        at = int((_longest(a[:half], b) + _longest(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _subsequence(a[:half], b[:at]) + [half + i for i in _subsequence(a[half:], b[at:])]
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        table[i, :m] = np.maximum(table[i + 1, :m], np.where(a[i] == b, table[i + 1, 1:] + 1, 0))
        table[i, :m] = np.maximum.accumulate(table[i, :m][::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j] and table[i, j] == table[i + 1, j + 1] + 1:
            out.append(i)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def _extend(a: np.ndarray, b: np.ndarray) -> int:
    """Words of ``a`` that go along with ``b`` from the start on, while matches outweigh mismatches."""
    n = min(len(a), len(b))
    if not n:
        return 0
    total = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    best = np.maximum.accumulate(np.maximum(total, 0))
    fallen = np.flatnonzero(best - total > DROP)
    total = total[: fallen[0]] if len(fallen) else total
    return int(total.argmax()) + 1 if len(total) and total.max() > 0 else 0


def dense(hits: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The longest range of which ``SIMILAR`` or more are hits, then what is left before and after it in the same way.

    Ends that would not be extended over (see ``_extend``) are cut off; ranges of under ``least`` are left out.
    """
    out, todo = [], [(0, len(hits))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        balance = np.concatenate([[0.0], np.cumsum(hits[a:b] - SIMILAR)])
        from_ = np.searchsorted(-np.minimum.accumulate(balance), -balance - 1e-9)
        end = int((np.arange(len(balance)) - from_).argmax())
        first = int(from_[end])
        if end - first < least:
            continue
        i, j = a + first, a + end
        todo += [(a, i), (j, b)]
        tail = np.cumsum(np.where(hits[i:j][::-1], 1, -2))
        j -= int(tail.argmin()) + 1 if tail.min() < 0 else 0
        head = np.cumsum(np.where(hits[i:j], 1, -2))
        i += int(head.argmin()) + 1 if len(head) and head.min() < 0 else 0
        if j - i >= least:
            out.append((i, j))
    return sorted(out)


def align(own: np.ndarray, other: np.ndarray, pos: list[int], at: list[int], low: int) -> list[tuple[int, int, np.ndarray]]:
    """First and end words in ``own`` of what goes along with ``other``, and which words match.

    A chain of which too little matches is cut into the parts of which enough does. ``other`` starts at word ``low`` of its document.
    """
    at = [x - low for x in at]
    matched = np.zeros(len(own), bool)
    i, j = pos[0], at[0]
    for p, r in zip(pos, at, strict=True):
        if p > i and r >= j:
            for k in _common(own[i:p], other[j:r]):
                matched[i + k] = True
        matched[max(i, p) : p + WORDS] = True
        i, j = max(i, p + WORDS), max(j, r + WORDS)
    first, end = pos[0], min(pos[-1] + WORDS, len(own))
    back = _extend(own[:first][::-1], other[: at[0]][::-1])
    matched[first - back : first] = own[first - back : first] == other[at[0] - back : at[0]]
    last = at[-1] + WORDS
    ahead = _extend(own[end:], other[last:])
    matched[end : end + ahead] = own[end : end + ahead] == other[last : last + ahead]
    first, end = first - back, end + ahead
    hits = matched[first:end]
    if hits.sum() >= SIMILAR * (end - first):
        return [(first, end, hits)] if end - first >= LEAST_SPAN else []
    return [(first + a, first + b, hits[a:b]) for a, b in dense(hits, LEAST_SPAN)]


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, chains: everything needed to align a document's chains."""
    links = materialize(_deal(docs, buckets_for(docs)).groupBy("bucket").applyInArrow(_meet, "doc_id long, pos int, to_id long, at int, long boolean"))
    chains = materialize(_chains(links))
    return _with_slices(chains, docs).groupBy("doc_id").agg(F.collect_list(F.struct("to_id", "low", "words", "pos", "at")).alias("chains"))


def joined(n: int, spans: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Word ranges of a text of ``n`` words that are passages by what all ``spans`` match together."""
    matched, inside = np.zeros(n, bool), np.zeros(n + 2, np.int8)
    for first, end, hits in spans:
        matched[first:end] |= hits
        inside[first + 1 : end + 1] = 1
    edge = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
    out: list[list[int]] = []
    for first, end in edge.tolist():
        if out and first - out[-1][1] <= SEAM:
            out[-1][1] = end
        else:
            out.append([first, end])
    whole = [(a, b) for a, b in out if matched[a:b].sum() >= SIMILAR * (b - a)]
    parts = [(a + i, a + j) for a, b in out if matched[a:b].sum() < SIMILAR * (b - a) for i, j in dense(matched[a:b], PASSAGE)]
    return sorted((a, b) for a, b in whole + parts if b - a >= PASSAGE)


def passages(text: bytes, chains: list[dict] | None) -> list[tuple[int, int, list[int]]]:
    """(first byte, end byte, source doc_ids) of the repeated passages of one text; none overlap."""
    if not chains:
        return []
    own = _word_hash32(text)
    found = []
    for c in sorted(chains, key=lambda c: (c["to_id"], c["pos"][0])):
        if c["pos"][-1] + WORDS <= len(own):
            found += [(span, int(c["to_id"])) for span in align(own, np.frombuffer(c["words"], np.uint32), list(c["pos"]), list(c["at"]), c["low"])]
    runs = joined(len(own), [span for span, _ in found])
    if not runs:
        return []
    inside = ~np.isin(np.frombuffer(text, np.uint8), [0x20, *range(0x09, 0x0E)])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))).reshape(-1, 2)
    return [(int(edge[a, 0]), int(edge[b - 1, 1]), sorted({to for (first, end, _), to in found if first < b and a < end})) for a, b in runs]


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed (words), n_spans, sources (doc_ids of earlier documents), spans (bytes of removed runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            rows = []
            for text, chains in zip(texts_as_bytes(batch), batch.column("chains").to_pylist(), strict=True):
                text = text or b""
                spans = passages(text, chains)
                keep = keep_mask(len(text), [{"first": a, "end": b} for a, b, _ in spans])
                runs = np.flatnonzero(np.diff(np.concatenate([[0], (~keep).astype(np.int8), [0]]))).reshape(-1, 2)
                total = len(text.split())
                removed = sum(len(text[a:b].split()) for a, b in runs.tolist())
                rows.append((total, removed, len(runs), sorted({x for *_, some in spans for x in some}), [{"first": a, "end": b} for a, b in runs.tolist()]))
            n, gone, count, sources, where = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sources, pa.list_(pa.int64())), pa.array(where, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_removed", "n_spans", "sources", "spans"],
            )

    return id_and_text(docs).join(_found(docs), "doc_id", "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, n_spans long, sources array<long>, spans array<struct<first:long,end:long>>")


def remove_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; all rows and columns stay, ``n_chars`` follows the text."""
    schema, mark, key = docs.schema, unused(docs, "chains_of_passages"), unused(docs, "id_of_passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            texts = []
            for text, chains in zip(texts_as_bytes(batch), batch.column(mark).to_pylist(), strict=True):
                spans = passages(text or b"", chains)
                keep = keep_mask(len(text or b""), [{"first": a, "end": b} for a, b, _ in spans])
                texts.append(text if not spans else np.frombuffer(text, np.uint8)[keep].tobytes())
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(texts, pa.binary()).cast(pa.string())
            if "n_chars" in columns:
                changed = pa.array([len(t.decode()) if t is not None and c else None for t, c in zip(texts, batch.column(mark).to_pylist(), strict=True)], pa.int64())
                columns["n_chars"] = pa.compute.coalesce(changed.cast(columns["n_chars"].type), columns["n_chars"])
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], [f.name for f in schema.fields])

    found = _found(docs)
    found = found.select(F.col("doc_id").alias(key), F.col("chains").alias(mark))
    return docs.join(found, docs["doc_id"].cast("long") == found[key], "left").drop(key).mapInArrow(run, schema)


def op7(docs: DataFrame) -> DataFrame:
    return repeated(docs)
