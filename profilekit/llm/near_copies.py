"""One document of each group of near copies: fingerprints within the radius, or texts whose shingles are similar enough.

The fingerprints' radius (``simhash``) stands for changes far smaller than a similarity of ``SIMILAR`` allows: such pairs
differ in up to a quarter of the bits, which no cover of masks can reach with useful buckets. So two ways bring candidates
together: the covering tables of ``simhash``, whose pairs are links as they are, and ``BANDS`` bands of ``ROWS`` minima of
hashed shingles (``WORDS`` words), whose pairs are checked by the exact Jaccard similarity of both texts' shingle sets.
A pair at the threshold meets in some band with probability 1 - (1 - SIMILAR^ROWS)^BANDS, over 0.999.

Equal texts (words in lower case) are one node throughout. In a band each node meets the first one there, and where that
and the other links leave the rest of a bucket in more than one group, all of the rest meet across groups: dealt into
chunks of ``CHUNK`` nodes, each two chunks are compared at once by exact counts of common shingles. So every pair that
shares a bucket is linked, reached through links, or found to be under ``SIMILAR``. Large buckets of near copies cost
a row a node; a bucket of m texts that are alike but under ``SIMILAR`` costs (m / ``CHUNK``)^2 comparisons of chunks.

Defined cases: texts without words are equal to each other; fewer words than a shingle make one shingle; rows without
doc_id are returned and take no part; rows that repeat a doc_id stay or go together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm import simhash, textstats
from profilekit.llm.common import connected_components, hold, id_and_text, looked_up, materialize, mix64, pieces, texts_as_bytes

WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 20, 5
#: Nodes of a bucket that are compared with as many others at once.
CHUNK = 512
#: Shingles whose minima are taken at once.
_BLOCK = 4096
_FACTORS = (np.random.default_rng(20240607).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the shingles, with repeats; none for a text without words."""
    h = textstats.word_hashes(text.lower().split())
    return textstats.rolling(h, min(WORDS, len(h))) if len(h) else h


def bands(grams: np.ndarray) -> np.ndarray:
    """A key for each band: the minima of its rows, hashed together."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(grams), _BLOCK):
            np.minimum(low, (grams[k : k + _BLOCK, None] * _FACTORS[None]).min(axis=0), out=low)
        keys = low.reshape(BANDS, ROWS)
        out = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            out = mix64(out ^ keys[:, r]) + np.uint64(0x9E3779B97F4A7C15)
    return out.view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, fp, same (128 bits of the words), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_copies")
        for batch in pieces(batches):
            texts = [t or b"" for t in texts_as_bytes(batch)]
            fps = np.array([simhash.fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            same = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts]
            keys = [bands(g) if len(g) else None for g in map(shingles, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "same", "bands"])

    return id_and_text(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, fp long, same binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, grams (sorted distinct 32-bit hashes) of the texts that candidates ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            packed = [np.unique((shingles(t or b"") >> np.uint64(32)).astype("<u4")).tobytes() for t in texts_as_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["node", "grams"])

    rows = id_and_text(docs).join(wanted, "doc_id", "left_semi")
    return rows.mapInArrow(run, "node long, grams binary").groupBy("node").agg(F.min("grams").alias("grams"))


def similar(pairs: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The (a, b) of ``pairs`` whose ``sets`` (node, grams) have a Jaccard similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                p, q = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("left")), "a")
    return left.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("right")), "b").mapInArrow(run, "a long, b long")


def _in_common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set of ``left`` has in common with each of ``right``; members of a set are distinct."""
    out = np.zeros((len(left), len(right)), np.float32)
    p, q = np.concatenate(left), np.concatenate(right)
    i, j = (np.repeat(np.arange(len(x)), [len(g) for g in x]) for x in (left, right))
    shared = np.intersect1d(p, q)
    p_at, q_at = np.searchsorted(shared, p), np.searchsorted(shared, q)
    for at, gram, row in ((p_at, p, i), (q_at, q, j)):
        at[np.append(shared, 0)[at] != gram] = len(shared)
        order = np.argsort(at, kind="stable")
        at[:], row[:] = at[order], row[order]
    for k in range(0, len(shared), _BLOCK):
        top = min(k + _BLOCK, len(shared))
        x, y = np.zeros((len(left), top - k), np.float32), np.zeros((len(right), top - k), np.float32)
        for table, at, row in ((x, p_at, i), (y, q_at, j)):
            lo, hi = np.searchsorted(at, [k, top])
            table[row[lo:hi], at[lo:hi] - k] = 1
        out += x @ y.T
    return out


def linked(nodes: np.ndarray, labels: np.ndarray, second: np.ndarray, sets: list[np.ndarray], least: float = SIMILAR) -> list[tuple[int, int]]:
    """Links between nodes of different labels at ``least`` or more, of the first with the second side, or of all where
    there is no second: each node that has some is tied to the smallest that these links reach."""
    own = np.flatnonzero(~second)
    other = np.flatnonzero(second) if second.any() else own
    if not len(own) or len(np.unique(labels)) < 2:
        return []
    both = _in_common([sets[k] for k in own], [sets[k] for k in other])
    size = np.array([len(g) for g in sets], np.float64)
    near = (both >= least * (size[own][:, None] + size[other][None] - both)) & (labels[own][:, None] != labels[other][None])
    a, b = np.nonzero(near)
    a, b, low = own[a], other[b], nodes.copy()
    while True:
        last = low.copy()
        np.minimum.at(low, a, last[b])
        np.minimum.at(low, b, last[a])
        if (low == last).all():
            return [(int(x), int(y)) for x, y in zip(nodes, low, strict=True) if x != y]


def _compared(table: pa.Table) -> pa.Table:
    column = {name: table.column(name).to_numpy() for name in ("node", "label", "second")}
    found = linked(column["node"].astype(np.int64), column["label"], column["second"].astype(bool), [np.frombuffer(g, "<u4") for g in table.column("grams").to_pylist()])
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def rest(met: DataFrame, labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) links that complete the buckets of ``met`` (band, key, node; without each bucket's first) by all pairs across labels."""
    bucket = ["band", "key"]
    of = met.select(*bucket, "node").join(labelled, "node")
    opened = of.groupBy(*bucket).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(*bucket)
    of = materialize(of.join(opened, bucket, "left_semi"))
    counts = materialize(of.groupBy(*bucket, "label").agg(F.count(F.lit(1)).alias("n")))
    pools = counts.groupBy(*bucket).agg(F.sum(F.when(F.col("n") < CHUNK, F.col("n"))).alias("pool"))
    sizes = materialize(counts.join(pools, bucket).select(*bucket, "label", "n", F.col("n").alias("size"), "pool"))
    big, parts = F.col("size") >= CHUNK, lambda n: F.ceil(F.col(n) / CHUNK).cast("long")
    chunk = F.when(big, F.struct(F.lit(True).alias("big"), F.col("label").alias("own"), F.pmod(F.xxhash64("node"), parts("size")).alias("part")))
    chunk = chunk.otherwise(F.struct(F.lit(False).alias("big"), F.lit(0).cast("long").alias("own"), F.pmod(F.xxhash64("label"), parts("pool")).alias("part")))
    dealt = materialize(looked_up(of, sizes, *bucket, "label").select(*bucket, "node", "label", chunk.alias("chunk")))
    chunks = dealt.select(*bucket, "chunk").distinct()
    twos = chunks.withColumnRenamed("chunk", "x").join(chunks.withColumnRenamed("chunk", "y"), bucket)
    twos = twos.where("x <= y and not (x.big and y.big and x.own = y.own)").withColumn("chunk", F.explode(F.array_distinct(F.array("x", "y"))))
    members = twos.join(dealt, [*bucket, "chunk"]).withColumn("second", F.col("chunk") != F.col("x")).select(*bucket, "x", "y", "second", "node", "label")
    return members.join(sets, "node").groupBy(*bucket, "x", "y").applyInArrow(_compared, "a long, b long").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that links reach. Rows without doc_id are left out."""
    rows = materialize(described(docs))
    nodes = materialize(rows.groupBy("same").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")))
    hubs = nodes.groupBy("fp").agg(F.min("node").alias("hub"))
    prints = simhash.links(materialize(hubs.select("fp")))
    of = lambda name, to: hubs.select(F.col("fp").alias(name), F.col("hub").alias(to))
    within = prints.select(F.col("a").alias("pa"), F.col("b").alias("pb")).join(of("pa", "a"), "pa").join(of("pb", "b"), "pb").select("a", "b")
    equal = nodes.join(hubs, "fp").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    known = materialize(within.union(equal).where("a <> b"))
    keyed = nodes.where("bands is not null").select("node", F.posexplode("bands").alias("band", "key"))
    first = materialize(keyed.groupBy("band", "key").agg(F.min("node").alias("b"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where("b <> last").drop("last"))
    met = materialize(looked_up(keyed, first, "band", "key").where("node <> b"))
    sets = materialize(_sets(docs, met.select(F.col("node").alias("doc_id")).union(met.select("b")).distinct()))
    pairs = materialize(met.select(F.col("node").alias("a"), "b").distinct().join(known, ["a", "b"], "left_anti"))
    labels = connected_components(known.union(similar(pairs, sets)))
    labelled = materialize(nodes.select("same", "n", "node").join(labels, "node", "left").select("same", "n", "node", F.coalesce("label", "node").alias("label")))
    name = lambda x: labelled.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
    further = rest(met, labelled.select("node", "label"), sets).join(name("a"), "a").join(name("b"), "b")
    joined = connected_components(further.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct())
    named = labelled.join(joined.select(F.col("node").alias("label"), F.col("label").alias("component")), "label", "left").select("same", "n", F.coalesce("component", "label").alias("component_id"))
    return looked_up(rows.select("doc_id", "same"), materialize(named), "same").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for those whose group has a smaller ``doc_id``; all columns as they were."""
    lost = groups(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("lost_id"))
    return docs.join(lost, docs["doc_id"].cast("long") == lost["lost_id"], "left_anti")
