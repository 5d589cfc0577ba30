"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents, so tokens are labelled first: a word that is found in a far larger share of toxic training
documents than of others (a z-score over ``Z``) is a toxic token where it stands in a toxic one, every other token is
clean. Words that go on from a telling beginning of ``STEMS`` letters count as one word, that beginning: lexicons inflect, and each
form alone is rare. A two-tag field over word identities (with their neighbours' as context) is fitted to segments of
these texts. In use, forward-backward gives each word its marginal of being toxic; a document's score is a logistic function,
fitted to the training documents, of the largest marginal, of the probability that any word is toxic, and of the
number expected. Spans are runs of words whose marginal is at least one half.

Training uses the labelled rows with crc32(doc_id) mod 5 <> 0, at most ``PER_CLASS`` documents a label, those with
the smallest hashes of their ids, and whole texts up to ``MAX_TRAIN_BYTES`` in all; nothing else is sampled. Scores depend
on the text alone.

Defined cases: null and empty texts have no words and score as such (all three features zero); several
labels of one id count by their largest; without both labels every score is 0; repeated rows are all scored;
null ids are scored, not trained on, and not held out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import Recent, crc_mod, hold, id_and_text, materialize, pieces

FOLDS, PER_CLASS, MAX_TRAIN_BYTES, MAX_WORDS = 5, 3000, 48 << 20, 20_000
Z, SEGMENT, STEPS = 5.5, 48, 150
STEMS = range(3, 9)
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_~`“”‘’«»…"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words worked on at once by the chains; one text may have more.
_TOKENS = 1 << 17


def numbered(index: dict[str, int], stems: dict[str, float]) -> Recent:
    """Number of a word as it stands in a text: its stem's, or its own; 0 if unknown."""
    return Recent(lambda raw: index.get(canonical(raw.strip(_STRIP).lower(), stems), 0))


def canonical(word: str, stems: dict[str, float]) -> str:
    """The most telling (longest) stem that ``word`` goes on from, marked by a plus sign; else the word."""
    best = max((s for k in STEMS if len(word) > k and (s := word[:k]) in stems), key=lambda s: (stems[s], len(s)), default=None)
    return word if best is None else best + "+"


def _words(text: str) -> list[str]:
    return _WORD.findall(text) if not text.isascii() else text.split() if not _ODD.search(text) else _WORD.findall(text)


_ODD = re.compile("[\x1c-\x1f]")


def chains(unary: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of tag 1 for each token, summed pair marginals and log-normalisers for each chain.

    ``unary``: log-odds of tag 1 for all tokens, chain after chain. Longer chains come first inside, so that step t
    works on all chains of over t tokens at once.
    """
    order = np.argsort(-lengths, kind="stable")
    n, first = lengths[order], (np.cumsum(lengths) - lengths)[order]
    e, k = np.exp(trans), len(n)
    odds = np.exp(np.clip(unary, -30, 30))
    forward, scale = np.zeros((len(unary), 2)), np.zeros(len(unary))
    live = np.searchsorted(-n, -np.arange(n[0] if k else 0), side="left")  # chains longer than t
    a = np.zeros((k, 2))
    for t, m in enumerate(live):
        at = first[:m] + t
        b = np.broadcast_to(np.exp(start), (m, 2)).copy() if t == 0 else a[:m] @ e
        b[:, 1] *= odds[at]
        c = b.sum(axis=1)
        a[:m] = b / c[:, None]
        forward[at], scale[at] = a[:m], c
    marginal, pairs, back = np.zeros(len(unary)), np.zeros((2, 2)), np.ones((k, 2))
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = first[:m] + t
        later = live[t + 1] if t + 1 < len(live) else 0
        if later:
            to = first[:later] + t + 1
            weighted = back[:later].copy()
            weighted[:, 1] *= odds[to]
            weighted /= scale[to][:, None]
            pairs += (forward[at[:later]].T @ weighted) * e
            back[:later] = weighted @ e.T
        g = forward[at] * back[:m]
        marginal[at] = g[:, 1] / g.sum(axis=1)
    return marginal, pairs, np.log(np.maximum(scale, 1e-300))


class Field:
    def __init__(self, words: list[str], stems: dict[str, float] | None = None):
        self.index, self.stems = {w: k + 1 for k, w in enumerate(words)}, stems or {}
        size = len(words) + 1
        self.own, self.near = np.zeros(size), np.zeros(size)
        self.bias, self.trans, self.start = -4.0, np.zeros((2, 2)), np.zeros(2)
        self.doc = np.zeros(4)

    def unary(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        near = self.near[ids]
        ends = np.cumsum(lengths)
        left, right = np.concatenate([[0], near[:-1]]), np.concatenate([near[1:], [0]])
        left[ends[:-1]] = 0
        right[ends - 1] = 0
        return self.bias + self.own[ids] + (left[: len(ids)] + right[: len(ids)])

    def fit(self, ids: np.ndarray, lengths: np.ndarray, tags: np.ndarray, steps: int = STEPS) -> None:
        """Adam on the mean conditional log-likelihood with L2."""
        size, n = len(self.own), len(ids)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        inner = np.ones(n, bool)
        inner[starts] = False
        gold = np.zeros((2, 2))
        np.add.at(gold, (tags[np.flatnonzero(inner) - 1], tags[inner]), 1)
        prev, nxt = np.concatenate([[0], ids[:-1]]), np.concatenate([ids[1:], [0]])
        prev[starts] = 0
        nxt[ends - 1] = 0
        p = np.concatenate([self.own, self.near, [self.bias], self.trans.ravel()])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for k in range(1, steps + 1):
            self.own, self.near, self.bias, self.trans = p[:size], p[size : 2 * size], p[2 * size], p[2 * size + 1 :].reshape(2, 2)
            marginal, pairs, _ = chains(self.unary(ids, lengths), lengths, self.trans, self.start)
            r = tags - marginal
            near = np.bincount(prev, r, size) + np.bincount(nxt, r, size)
            near[0] = 0
            own = np.bincount(ids, r, size)
            own[0] = 0
            g = np.concatenate([own, near, [r.sum()], (gold - pairs).ravel()]) / len(lengths) - 1e-5 * p
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            p = p + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        self.own, self.near, self.bias, self.trans = p[:size].copy(), p[size : 2 * size].copy(), float(p[2 * size]), p[2 * size + 1 :].reshape(2, 2).copy()

    def marginals(self, texts: Iterable[str | None], known: Recent | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, marginals of its words), in order; ``known`` remembers words from call to call."""
        bare = numbered(self.index, self.stems) if known is None else known

        def numbers(text: str | None) -> np.ndarray:
            words = _words(text or "")
            return np.fromiter(map(bare.__getitem__, words), np.int64, len(words))

        return self.marginals_of(map(numbers, texts))

    def marginals_of(self, cases: Iterable[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """The same of numbered words; texts go together up to ``_TOKENS`` words."""
        held: list[np.ndarray] = []
        done = total = 0

        def work() -> Iterator[tuple[int, np.ndarray]]:
            lengths = np.array([len(x) for x in held])
            ids = np.concatenate(held)
            some = lengths[lengths > 0]
            flat = chains(self.unary(ids, some), some, self.trans, self.start)[0] if len(ids) else np.zeros(0)
            at = np.cumsum(lengths) - lengths
            for x, (i, n) in enumerate(zip(at, lengths, strict=True)):
                yield done + x, flat[i : i + n]

        for ids in cases:
            held.append(ids)
            total += len(ids)
            if total >= _TOKENS:
                yield from work()
                done, held, total = done + len(held), [], 0
        if held:
            yield from work()

    @staticmethod
    def summary(marginal: np.ndarray) -> tuple[float, float, float]:
        if not len(marginal):
            return 0.0, 0.0, 0.0
        return float(marginal.max()), float(-np.expm1(np.log1p(-np.minimum(marginal, 1 - 1e-9)).sum())), float(np.log1p(marginal.sum()))

    def score(self, marginal: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.doc[0] + self.doc[1:] @ self.summary(marginal), -60, 60))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a little L2."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
    return w


def _telling(found: np.ndarray, n: np.ndarray) -> np.ndarray:
    """z-scores of document frequencies [label, word] between the labels; 0 where the toxic share is not three times as large."""
    share = found / np.maximum(n, 1)[:, None]
    pooled = found.sum(0) / max(1, n.sum())
    z = (share[1] - share[0]) / np.sqrt(pooled * (1 - pooled) * (1 / max(1, n[0]) + 1 / max(1, n[1])) + 1e-12)
    return np.where(share[1] > 3 * share[0], z, 0)


def train(texts: Iterable[str], toxic: np.ndarray) -> Field:
    """Texts are taken one by one and kept as numbers of words."""
    number: dict[str, int] = {}
    bare: dict[str, int] = {}
    cases: list[np.ndarray] = []
    for text in texts:
        words = _words(text)
        for raw in words:
            if raw not in bare:
                bare[raw] = number.setdefault(raw.strip(_STRIP).lower(), len(number))
        cases.append(np.fromiter(map(bare.__getitem__, words), np.int32, len(words)))
    del bare
    vocabulary, n = list(number), np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    if n.min() == 0:
        field = Field([])
        field.doc = np.array([-60.0, 0, 0, 0])
        return field

    def frequencies(ids: np.ndarray, size: int) -> np.ndarray:
        """Documents of each label that hold each id; ``ids`` are by word number, negative ones do not count."""
        out = np.zeros((2, size), np.int64)
        for c, y in zip(cases, toxic, strict=True):
            seen = np.unique(ids[c])
            out[y, seen[seen >= 0]] += 1
        return out

    stems: dict[str, float] = {}
    for k in STEMS:
        begins: dict[str, int] = {}
        ids = np.array([begins.setdefault(w[:k], len(begins)) if len(w) > k else -1 for w in vocabulary], np.int64)
        z = _telling(frequencies(ids, len(begins)), n)
        stems |= {s: float(z[i]) for s, i in begins.items() if z[i] > Z}
    merged: dict[str, int] = {}
    ids = np.array([merged.setdefault(canonical(w, stems), len(merged)) for w in vocabulary], np.int64)
    found, names = frequencies(ids, len(merged)), list(merged)
    total = found.sum(0)
    frequent = [i for i in np.argsort(-total, kind="stable")[:MAX_WORDS].tolist() if total[i] >= 3]
    field = Field([names[i] for i in frequent], stems)
    sign = np.zeros(len(merged), bool)
    sign[frequent] = _telling(found, n)[frequent] > Z
    index = np.array([field.index.get(x, 0) for x in names], np.int64)[ids]  # by word number
    sign = sign[ids]
    parts_ids, parts_tags, lengths = [], [], []
    for k, (c, y) in enumerate(zip(cases, toxic, strict=True)):
        parts = range(0, len(c), SEGMENT)
        chosen = [s for s in parts if sign[c[s : s + SEGMENT]].any()]
        if not chosen and len(parts):
            chosen = [parts[k % len(parts)]]
        for s in chosen:
            part = c[s : s + SEGMENT]
            parts_ids.append(index[part])
            parts_tags.append((sign[part] & bool(y)).astype(np.int64))
            lengths.append(len(part))
    if lengths:
        field.fit(np.concatenate(parts_ids), np.array(lengths), np.concatenate(parts_tags))
    x = np.array([field.summary(m) for _, m in field.marginals_of(index[c] for c in cases)])
    field.doc = _logistic(x, toxic.astype(float))
    return field


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Iterator[str], np.ndarray]:
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") >= 1).cast("int").alias("toxic"))
    known = known.where(crc_mod(F.col("doc_id"), FOLDS) != 0)
    chosen = None
    for k in (0, 1):
        part = known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    few = chosen.collect()  # at most 2 * per_class ids and labels
    label = {r["doc_id"]: r["toxic"] for r in few}
    if not label:
        return iter(()), np.zeros(0, int)
    spark = docs.sparkSession

    def ids(some: Iterable[int]) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(k,) for k in some], "doc_id long"))  # at most 2 * per_class

    rows = materialize(id_and_text(docs).where("text is not null").join(ids(label), "doc_id").withColumn("bytes", F.octet_length("text")))
    total, last, keep = 0, None, set()
    for k, size in sorted((r["doc_id"], r["bytes"]) for r in rows.select("doc_id", "bytes").collect()):
        if k != last and total + size <= MAX_TRAIN_BYTES:
            total, last = total + size, k
            keep.add(k)
    table = rows.join(ids(keep), "doc_id").select("doc_id", "text").orderBy("doc_id", "text").toArrow() if keep else None
    if table is None:
        return iter(()), np.zeros(0, int)
    texts = (t for batch in table.to_batches(max_chunksize=64) for t in batch.column("text").to_pylist())
    return texts, np.array([label[k] for k in table.column("doc_id").to_pylist()], int)


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    return train(*training_rows(docs, labels))


def scores(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, spans (first and end character of each toxic run of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        known = numbered(field.index, field.stems)
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            values, spans = [], []
            for k, marginal in field.marginals(texts, known):
                values.append(field.score(marginal))
                hit = np.flatnonzero(np.diff(np.concatenate([[0], (marginal >= 0.5).astype(np.int8), [0]]))).reshape(-1, 2)
                where = [m.span() for m in _WORD.finditer(texts[k])] if len(hit) else []
                spans.append([{"first": where[a][0], "end": where[b - 1][1]} for a, b in hit.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))], ["doc_id", "score", "spans"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, spans array<struct<first:int,end:int>>")


def keep_clean(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs`` with a score under one half, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        known = numbered(field.index, field.stems)
        for batch in pieces(batches):
            values = [field.score(m) for _, m in field.marginals(batch.column("text").to_pylist(), known)]
            yield batch.filter(pa.array([v < 0.5 for v in values], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return scores(docs, fit(docs, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
