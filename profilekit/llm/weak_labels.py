"""Quality by weak labels: expectation-maximisation over overlapping heuristic labellers, then a hashed linear scorer.

Each labeller speaks for one side or keeps silent. The votes of all documents fall in at most 2^n patterns, whose
counts are all that the model needs: a two-class model with the rates at which each labeller speaks in either class
is fitted to them by expectation-maximisation, without any labelled row. The posterior of a document's pattern is
its label. A logistic scorer over hashed features (shapes of words, repetition, rates) is then fitted to these
posteriors on at most ``SAMPLE`` documents, those with the smallest hashes of their ids; everything else covers all rows.

Defined cases: null text is empty; a text with under ``LEAST_WORDS`` words is rejected whatever its score; repeated
rows are all scored; null ids are scored, but never part of the sample; if all documents vote alike, the posterior
follows the majority of votes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm import textstats
from profilekit.llm.common import Recent, hold, id_and_text, materialize, pieces, texts_as_bytes

#: The last ``FAVOURABLE`` speak for a document, the others against it; each may keep silent.
LABELLERS = ("symbols", "symbols_per_word", "repetition", "same_word", "capitals", "exclamations", "fields", "lines", "sentences", "casing")
FAVOURABLE = 2
CELLS, SAMPLE, LEAST_WORDS, ROUNDS = 2048, 20_000, 1, 60
_SHAPE = bytes(65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else 48 if 48 <= b < 58 else b for b in range(256))


def _cell(word: bytes) -> int:
    """Cell of a word's shape: letters, capitals and digits run together, other characters as they are."""
    shape = word.translate(_SHAPE)
    return xxhash.xxh3_64_intdigest(bytes(b for k, b in enumerate(shape) if not k or b != shape[k - 1])) % (CELLS - 128) + 128


_SHAPES = Recent(_cell)


def describe(text: bytes | None) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words, pattern of votes (a bit for each labeller), cells and values of the scorer's features."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, np.zeros(0, np.int32), np.zeros(0, np.float32)
    h = textstats.word_hashes(words)
    chars, symbols, upper, lower = textstats.classes(text)
    lines, same_lines = textstats.repeated_lines(text)
    rates = (
        symbols / max(1, chars),
        symbols / n,
        float(textstats.repeated_words(h).mean()),
        float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
        upper / max(1, upper + lower),
        text.count(b"!!") / n,
        text.count(b" | ") / n,
        same_lines / max(1, lines),
        (text.count(b". ") + text.count(b".\n")) / n,
    )
    sym, per_word, rep, same, cap, bang, bar, dup, end = rates
    votes = (sym > 0.08, per_word > 0.2, rep > 0.25, same > 0.15, cap > 0.5, bang > 0.2, bar > 0.15, dup > 0.3, 0.01 < end < 0.5, 0 < cap < 0.45)
    pattern = sum(v << k for k, v in enumerate(votes))
    cells, counts = np.unique(np.fromiter(map(_SHAPES.__getitem__, words), np.int32, n), return_counts=True)
    extra = [8 * k + min(7, int(r * 16)) for k, r in enumerate(rates)]
    return n, pattern, np.concatenate([extra, cells]).astype(np.int32), np.concatenate([np.ones(len(extra)), np.sqrt(counts / n)]).astype(np.float32)


def described(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("weak_labels", _SHAPES.clear)
        for batch in pieces(batches):
            n, pattern, cells, values = zip(*map(describe, texts_as_bytes(batch)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(pattern, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["doc_id", "n_words", "pattern", "cells", "vals"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, pattern int, cells array<int>, vals array<float>")


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of "good" for each pattern, rates [class, labeller] at which a labeller speaks, prior of "good"."""
    fires = (patterns[:, None] >> np.arange(len(LABELLERS)) & 1).astype(float)
    against = fires[:, : len(LABELLERS) - FAVOURABLE].sum(1)
    posterior = np.where(against == 0, 0.95, np.where(against == 1, 0.3, 0.02))
    prior, rates = 0.5, np.full((2, len(LABELLERS)), 0.5)
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        rates = (weight @ fires + 0.5) / (weight.sum(1, keepdims=True) + 1)
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        scores = fires @ np.log(rates).T + (1 - fires) @ np.log1p(-rates).T + np.log([1 - prior, prior])
        posterior = 1 / (1 + np.exp(np.clip(scores[:, 0] - scores[:, 1], -500, 500)))
    return posterior, rates, prior


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with L2 on sparse rows by accelerated full gradients."""
    if not len(rows):
        return np.zeros(CELLS), 0.0
    lengths = np.array([len(c) for c, _ in rows])
    at, cells, values = np.repeat(np.arange(len(rows)), lengths), np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]).astype(float)
    balance = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    w, b, step = np.zeros(CELLS), 0.0, 1.0
    mw, mb = w.copy(), b
    for k in range(steps):
        z = np.bincount(at, values * mw[cells], len(rows)) + mb
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target) * balance
        nw, nb = mw - step * (np.bincount(cells, values * g[at], CELLS) + 1e-5 * mw), mb - step * g.sum()
        mw, mb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


class Model:
    def __init__(self, posterior: dict[int, float], weights: np.ndarray, bias: float, tables: np.ndarray, prior: float):
        self.posterior, self.weights, self.bias, self.tables, self.prior = posterior, weights, bias, tables, prior

    def score(self, cells: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[cells] @ values + self.bias, -60, 60)))) if len(cells) else 0.0

    def accepts(self, n_words: int, cells: np.ndarray, values: np.ndarray) -> bool:
        return n_words >= LEAST_WORDS and self.score(cells, values) >= 0.5


def fit(table: DataFrame) -> Model:
    """``table``: described() of all documents, as a written table."""
    seen = table.where("n_words > 0").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").toArrow()  # at most 2^n rows
    patterns, counts = seen["pattern"].to_numpy(), seen["n"].to_numpy()
    if not len(patterns):
        return Model({}, np.zeros(CELLS), 0.0, np.zeros((2, len(LABELLERS))), 0.5)
    posterior, tables, prior = fit_votes(patterns, counts)
    label = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    some = table.where("n_words > 0 and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("pattern", "cells", "vals").toArrow()
    rows = list(zip(map(np.array, some["cells"].to_pylist()), map(np.array, some["vals"].to_pylist()), strict=True))
    weights, bias = fit_scorer(rows, np.array([label[p] for p in some["pattern"].to_pylist()]))
    return Model(label, weights.astype(np.float32), bias, tables, prior)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, posterior, score, accepted for every row."""
    table = materialize(described(docs))
    model = fit(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, pattern, cells, values = (batch.column(c).to_pylist() for c in ("n_words", "pattern", "cells", "vals"))
            pairs = [(np.array(c, np.int32), np.array(v, np.float32)) for c, v in zip(cells, values, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array([model.posterior.get(p, 0.0) if k else 0.0 for p, k in zip(pattern, n, strict=True)]), pa.array([model.score(*p) for p in pairs]), pa.array([model.accepts(k, *p) for k, p in zip(n, pairs, strict=True)])],
                ["doc_id", "n_words", "posterior", "score", "accepted"],
            )

    return table.mapInArrow(run, "doc_id long, n_words long, posterior double, score double, accepted boolean")


def keep_accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the scorer accepts, all columns as they were; the text is judged where it lies, without a shuffle."""
    model = fit(materialize(described(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("weak_labels", _SHAPES.clear)
        for batch in pieces(batches):
            marks = [model.accepts(n, cells, values) for n, _, cells, values in map(describe, texts_as_bytes(batch))]
            yield batch.filter(pa.array(marks, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9(docs: DataFrame) -> DataFrame:
    return judge(docs)


