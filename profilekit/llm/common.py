"""What the operators of this subpackage share: inputs, durable intermediate tables, seed exchange, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of strings, of one Arrow batch that are worked on together; one row may have more bytes.
SUB_BATCH, SUB_BYTES = 1024, 2 << 20
#: Entries of each half of a cache, and the longest key that is kept: about 20 MB a cache with keys and values of usual size.
CACHED, LONGEST_KEY = 50_000, 48
#: Bytes of one Arrow batch between the JVM and a Python worker; one row may have more. Both sides hold such batches whole.
BATCH_BYTES = 4 << 20
_LOCAL_DIRS: dict[str, str] = {}


_HELD: dict[str, Callable[[], object]] = {}


def hold(owner: str, release: Callable[[], object] = lambda: None) -> None:
    """Called where an operator starts in a Python worker: tables that other operators keep there are released.

    Workers serve all stages of a pipeline in turn; without this they would gather the tables of each. Freed memory
    goes back to the system, where the C library can do that.
    """
    others = [x for x in _HELD if x != owner]
    for other in others:
        _HELD.pop(other)()
    _HELD[owner] = release
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


class Recent(dict):
    """What ``make`` gives for a key, remembered for the keys used of late: at most twice ``CACHED`` of them.

    When the young half is full it becomes the old half; what is used again moves back. Longer keys than ``LONGEST_KEY`` are
    made each time.
    """

    def __init__(self, make: Callable[[Hashable], object], limit: int = CACHED):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: Hashable) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST_KEY:
                return value
        self.put(key, value)
        return value

    def put(self, key: Hashable, value: object) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            super().clear()
        self[key] = value

    def clear(self) -> None:
        super().clear()
        self.old = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the columns that matter, so that further columns cannot clash with those made here."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it with as many underscores as make it the name of no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only where that is unset and
    driver and executors are one process. On a cluster without that setting this is an error: executors would write to
    their own disks."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="profilekit-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return "file://" + _LOCAL_DIRS[app]


def in_bytes(setting: str) -> int:
    """Of a setting such as 262144, 256k or 64MB."""
    number = setting.strip().lower().removesuffix("b")
    power = "bkmgtp".find(number[-1:])
    return int(number[:-1] if power > 0 else number) << 10 * max(power, 0)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    The result is compact, can be pruned by column, and does not depend on the executors that made it. While it is written,
    Arrow batches have at most ``BATCH_BYTES``, or what the session sets where that is less.
    """
    spark, size = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path, before = f"{shared_dir(spark)}/profilekit-{uuid.uuid4().hex}", spark.conf.get(size)
    spark.conf.set(size, str(min(in_bytes(before), BATCH_BYTES)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(size, before)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = SUB_BATCH, size: int = SUB_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes of strings and binaries, of one row at least."""
    for batch in batches:
        total = np.zeros(batch.num_rows + 1, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                total[1:] += pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(total), 0
        while at < batch.num_rows:
            end = int(np.searchsorted(total, total[at] + size, side="right")) - 1
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def texts_as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


#: Keys that are looked up by broadcast: those with more than a ``HOT``-th of all rows, so fewer than ``HOT`` keys.
HOT = 1000


def looked_up(rows: DataFrame, table: DataFrame, *key: str) -> DataFrame:
    """``rows`` joined to ``table`` on ``key``, of which ``table`` has each at most once, with how many rows have it in ``n``.

    Rows of frequent keys stay where they are: the table's rows for them, fewer than ``HOT``, are broadcast. The others
    are shuffled. Both are tables that were written; ``n`` is left out. Rows with a null key are, too.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    often, columns = F.col("n") > total / HOT, [c for c in table.columns if c not in (*key, "n")]
    known = rows.join(F.broadcast(table.where(often).drop("n").withColumn("is_often", F.lit(True))), list(key), "left")
    few = known.where("is_often is null").drop(*columns, "is_often").join(table.where(~often).drop("n"), list(key))
    order = [*key, *[c for c in rows.columns if c not in key], *columns]
    return known.where("is_often").select(*order).union(few.select(*order))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges over longs -> (node, label): the smallest node reachable. Distributed; no path is collected.

    Each round takes the smallest label among neighbours and then follows labels of labels, so chains shrink
    by doubling; every round is a table in the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("label").alias("seen"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialize(stepped.join(target, "label", "left").select("node", "old", F.least("label", "further").alias("label")))
        labels = new.select("node", "label")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
