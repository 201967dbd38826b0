"""Tables that end a plan: rows go to the folder that the cluster shares, and what follows starts from there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df, worked out now and kept in the folder that spark.checkpoint.dir names; a temporary one in local mode, where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="tallywharf-"))
    return df.checkpoint()
