"""Quality by a hashed n-gram log-likelihood ratio between trusted text and the raw corpus.

Unigrams and bigrams of words are hashed to ``BUCKETS`` cells. Counts over every document give the raw multinomial,
counts over every document labelled as good the trusted one, both smoothed. A document's score is the sum
of log-ratios of its n-grams divided by their number. The threshold is fixed by all labelled documents that pass the
base rules: the score, on a grid of ``GRID`` cells, under which the share of good ones lost plus the share of bad
ones kept is least (good ones weigh ``CARE`` times; where a range of scores does equally well, as in the gap between both
kinds, its middle, and the lowest such range). Nothing is drawn at random.

Defined cases: null text has no words; a text without n-grams scores 0 (base rules reject it); without trusted
documents all scores are 0 and the base rules decide; without bad labels every score passes; several labels of one
id count by their largest; repeated rows are all scored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm import textstats
from profilekit.llm.common import id_and_text, materialize, pieces, texts_as_bytes

BUCKETS, SMOOTH, GRID, CARE = 1 << 16, 0.5, 4096, 4.0
#: Slots of the table that tells which texts may be trusted: its broadcast has this bound at any size.
SIEVE = 1 << 20


def _cells(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h >> np.uint64(48), (textstats.rolling(h, 2) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)]).astype(np.int64)


def _counted(texts: DataFrame) -> np.ndarray:
    """Counts of every cell over the texts, combined in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in pieces(batches):
            for text in texts_as_bytes(batch):
                counts += np.bincount(_cells(textstats.word_hashes((text or b"").split())), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["cell", "n"])

    parts = texts.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)  # at most BUCKETS rows
    out[parts["cell"].to_numpy()] = parts["n"].to_numpy()
    return out


def trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ``trusted``. Texts of others are sorted out where they lie, by a table of at most
    ``SIEVE`` hash values, before the rest are shuffled for an exact semi-join."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE))
    slots = trusted.select(slot.alias("slot")).distinct()
    near = id_and_text(docs).withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi")  # at most SIEVE longs
    return near.select("doc_id", "text").join(trusted.select("doc_id").hint("merge"), "doc_id", "left_semi")


def corpus_counts(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every cell over all documents, and over those whose doc_id is in ``trusted``."""
    return _counted(id_and_text(docs)), _counted(trusted_texts(docs, trusted))


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + SMOOTH) / (good.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))


def statistics(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Base statistics and the length-normalised score of every row."""
    small = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for text in texts_as_bytes(batch):
                text = text or b""
                h = textstats.word_hashes(text.split())
                chars, symbols, _, _ = textstats.classes(text)
                cells = _cells(h)
                score = float(small[cells].sum(dtype=np.float64) / len(cells)) if len(cells) else 0.0
                rows.append((len(h), chars, symbols, textstats.repeated_lines(text)[1], int(textstats.repeated_words(h).sum()), score))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    known = materialize(scored.where(~F.col("base_failed")).join(labels, "doc_id").where("quality is not null").select("quality", "score"))
    low, high, classes = known.agg(F.min("score"), F.max("score"), F.countDistinct("quality")).first()
    if classes < 2 or low == high:
        return float("-inf")
    cell = F.least(F.floor((F.col("score") - low) / ((high - low) / GRID)), F.lit(GRID - 1))
    table = known.groupBy(cell.alias("cell")).agg(F.sum(F.when(F.col("quality") >= 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") < 1, 1).otherwise(0)).alias("bad")).toArrow()
    good, bad = np.zeros(GRID + 1), np.zeros(GRID + 1)  # at most GRID rows
    good[table["cell"].to_numpy() + 1], bad[table["cell"].to_numpy() + 1] = table["good"].to_numpy(), table["bad"].to_numpy()
    loss = CARE * np.cumsum(good) / good.sum() + 1 - np.cumsum(bad) / bad.sum()
    first = int(np.argmin(loss))
    if not first:
        return float("-inf")
    worse = np.flatnonzero(loss[first:] > loss[first] + 1e-12)
    last = first + (int(worse[0]) if len(worse) else len(loss) - first) - 1
    return low + (first + last) / 2 * (high - low) / GRID


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    by_id = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    weights = log_ratios(*corpus_counts(docs, by_id.where("quality >= 1")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = materialize(statistics(docs, weights)).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold(scored, by_id)))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
