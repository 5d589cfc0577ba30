"""Metrics of a stream: the counters of the registry that can be combined, by event-time window, with late data let in
up to a watermark. A continuous profile for Structured Streaming sources; batch tables are better served by a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from profilekit import identifiers as ids
from profilekit.plans import registry
from profilekit.plans.tree import schema_tree, select

#: Metrics whose state has a fixed size, so that a window costs the same however many rows it gets.
STEADY = ("null_count", "nan_count", "finite_count", "min", "max", "mean", "zero_count", "negative_count", "positive_count", "empty_count", "min_length", "max_length", "mean_length", "true_count", "false_count", "min_size", "max_size", "total_element_count", "total_entry_count", "approx_distinct_count")


def windowed_metrics(stream: DataFrame, event_time: str, window: str = "1 minute", watermark: str = "10 minutes", columns: Sequence[str] | None = None, metrics: Sequence[str] = STEADY, rsd: float = 0.02) -> DataFrame:
    """window_start, window_end, path, metric, number; one row a window, field and metric. Works on batches alike."""
    nodes, _ = select(schema_tree(stream.schema), columns)
    cells, named = [F.count(F.lit(1)).alias("a0000")], [("", "row_count")]
    for node in nodes:
        site = registry.column_site(node)
        for m in registry.column_metrics(node):
            if m.name in metrics and (m.value_type in ("integer", "float", "mean") or node.kind in ("integer", "float", "decimal")):
                sql = m.sql
                for k, v in (site | {"rsd": f"{rsd}D"}).items():
                    sql = sql.replace("{" + k + "}", v)
                cells.append(F.expr(sql).alias(f"a{len(cells):04d}"))
                named.append((node.display, m.name))
    time = F.col(ids.quote(event_time))
    wide = stream.withWatermark(event_time, watermark).groupBy(F.window(time, window)).agg(*cells)
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(m).alias("metric"), F.col(f"a{k:04d}").cast("double").alias("number")) for k, (p, m) in enumerate(named)])
    return wide.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), F.inline(rows))


def start(metrics: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Append closed windows to Parquet files at ``path``; exactly once, from the checkpoint after a failure."""
    writer = metrics.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
