"""Cut lineage safely: reliable checkpoints in the folder the cluster names.

``localCheckpoint`` keeps blocks on executors and is lost with them; a reliable
checkpoint is written to ``spark.checkpoint.dir`` (a shared folder) and survives.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows that are worth a task of their own.
LEAST_ROWS = 25_000


def pin(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and read it back from the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """The pinned ``df``, dealt out anew where a few of its parts hold most rows (a file of few row groups).

    Steps that read it many times, like fits, then keep all cores busy; ``most`` limits a task's rows.
    Tables too small for two tasks stay as they are."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # a row for each part
    n = sum(sizes)
    parts = min(df.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS)
    parts = max(1, parts, math.ceil(n / most) if most else 1)
    return df if n == 0 or max(sizes) <= 2 * math.ceil(n / parts) else pin(df.repartition(parts))
