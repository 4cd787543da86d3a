"""Materialisation points.

Derived state tables (per route / bank / network x tick cells) are bounded by keys x ticks, not by the
fact table.  They are written once as parquet into the shared folder (survives executor loss, cuts
lineage) and read back; the read-back relation carries real file sizes, so the optimizer's choice between
a broadcast and a shuffle join rests on a measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage with a written table in the shared folder (never a local checkpoint)."""
    from routewise.sources.sinks import shared_path
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
