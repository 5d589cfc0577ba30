"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 values (seed 42) of the text's
shingles of words. Two fingerprints are linked if they differ in at most ``RADIUS`` bits; documents reach each
other through links. Every document gets the smallest ``doc_id`` it reaches.

Tables: bit i carries the vector m(i) of three bits; for each of the seven non-zero vectors v, one table keeps
the bits i with <m(i), v> = 1. Any two differing bits leave a non-zero v orthogonal to both, so every pair within
the radius shares a bucket of some table. Fingerprints alone in all their buckets end here. Where two share a bucket
they are compared. A larger bucket forms no pairs: its members agree on the table's bits, so two of them are within two
bits exactly if they share a member of their "one of the other bits flipped, or none" sets; each emits those (about 30)
inside the bucket and is tied to the smallest fingerprint that meets there; no more than these can meet at one. Work is
linear in distinct fingerprints however large a group is, and copies count once.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle; repeated rows are all returned; a null ``doc_id`` is returned and
never becomes a component's name unless no other id is there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import connected_components, hex64, id_and_text, looked_up, materialize, pieces, texts_as_bytes

RADIUS, SEED, WORDS = 2, 42, 3
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text, at any length with bounded extra memory."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], at + 1])
    ends = np.concatenate([at, [len(joined)]])
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, _BLOCK):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[k : k + _BLOCK], ends[k : k + _BLOCK], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([fingerprint(t, words) for t in texts_as_bytes(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def cover_masks() -> list[int]:
    """Seven masks as signed longs; see the module's text."""
    masks = []
    for v in range(1, 8):
        bits = sum(1 << i for i in range(64) if bin((i % 7 + 1) & v).count("1") % 2)
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    return masks


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) over a table of distinct ``fp``: enough links to connect all that are within two bits."""
    masks = cover_masks()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    buckets = materialize(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"))
    twos = buckets.where("n = 2").where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= RADIUS).select(F.col("hi").alias("a"), F.col("lo").alias("b"))
    one = lambda i: F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")
    others = F.array(*[F.array(F.lit(0).cast("long"), *[one(i) for i in range(64) if not m >> i & 1]) for m in masks])
    members = keyed.join(buckets.where("n > 2").select("t", "key"), ["t", "key"], "left_semi")
    flips = F.transform(F.element_at(others, F.col("t") + 1), lambda bit: F.col("fp").bitwiseXOR(bit))
    met = materialize(members.select("fp", "t", F.explode(flips).alias("mid")))  # ``mid`` keeps the table's bits, and so tells the bucket
    hubs = met.groupBy("t", "mid").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("t", "mid", "lo")
    more = met.join(hubs, ["t", "mid"]).where("fp <> lo").select(F.col("fp").alias("a"), F.col("lo").alias("b"))
    return twos.union(more).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp long, component_id: the smallest doc_id reachable through links."""
    prints = materialize(fingerprints(docs, words))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    labels = connected_components(links(distinct))
    parts = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first_id", "n", F.coalesce("label", "fp").alias("part"))
    names = parts.groupBy("part").agg(F.min("first_id").alias("component_id"))
    by_print = materialize(parts.join(names, "part").select("fp", "n", "component_id"))
    return looked_up(prints, by_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for those whose group has a smaller ``doc_id``; all columns as they were.

    Rows that repeat the kept id are exact repetitions of a key and stay; rows without an id stay.
    """
    lost = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(lost, docs["doc_id"].cast("long") == lost["doc_id"], "left_anti")


def op8(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
