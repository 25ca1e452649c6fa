"""Cutting the lineage of small tables that loops read again and again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as it is now, kept in the shared folder of spark.checkpoint.dir, so that lost executors cost no rerun.

    Only a local session may leave that setting out, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or f"file://{tempfile.gettempdir()}/checkpoints")
    return df.checkpoint()
