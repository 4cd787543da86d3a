"""Run a streaming query until its input is drained, into the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routewise.sources.sinks import drop_folder, shared_path


def drain(spark: SparkSession, stream: DataFrame, name: str, schema: T.StructType, output_mode: str = "append",
          per_batch: Callable[[DataFrame, int, str], DataFrame] | None = None,
          path: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Drain all available input; (result with ``batch_id``, progress of every micro-batch).

    Each micro-batch overwrites a folder of its own, named by its id, so a batch that runs again after a
    failure replaces its first try.  Result and checkpoint lie under ``path``: called again with the same
    path, a query goes on where it ended.  ``per_batch`` maps a batch, its id and the result folder to
    the rows to keep; it may read the batch many times, so the batch is written first and read back in the
    caller's session (a stream's own session plans every shuffle with all its partitions).
    """
    root = path or shared_path(spark, name)
    out = f"{root}/result"

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows, events = batch, f"{root}/events/{batch_id}"
        if per_batch:
            batch.write.mode("overwrite").parquet(events)
            rows = per_batch(spark.read.schema(batch.schema).parquet(events), batch_id, out)
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if per_batch:
            drop_folder(spark, events)

    q = (stream.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    progress: dict[int, dict] = {}
    ended = False
    while not ended:   # the query itself keeps only the latest reports
        ended = q.awaitTermination(0.5)
        progress |= {p["batchId"]: p for p in q.recentProgress}
    try:
        res = spark.read.schema(T.StructType([*schema, T.StructField("batch_id", T.LongType())])).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        res = spark.createDataFrame([], T.StructType([*schema, T.StructField("batch_id", T.LongType())]))
    return res, [progress[k] for k in sorted(progress)]


def run_available_now(spark: SparkSession, stream: DataFrame, name: str, output_mode: str = "update",
                      keys: Sequence[str] | None = None, path: str | None = None) -> tuple[DataFrame, list[dict]]:
    """:func:`drain`, and in update mode the latest version of each key."""
    res, progress = drain(spark, stream, name, stream.schema, output_mode, path=path)
    if not keys:
        return res.drop("batch_id"), progress
    others = [c for c in stream.columns if c not in keys]
    res = (res.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_v"))
           .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in others]))
    return res, progress


def dropped_by_watermark(progress: list[dict]) -> int:
    return int(sum(op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p.get("stateOperators", [])))


def state_rows(progress: list[dict]) -> list[tuple[int, int, int]]:
    """(batch, state rows, rows removed) per micro-batch from progress reports."""
    out = []
    for p in progress:
        ops = p.get("stateOperators", [])
        out.append((int(p.get("batchId", 0)), int(sum(o.get("numRowsTotal", 0) for o in ops)),
                    int(sum(o.get("numRowsRemoved", 0) for o in ops))))
    return out
