"""Results kept in the shared folder, so that plans stay short and a lost executor costs no recomputation."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def materialized(df: DataFrame) -> DataFrame:
    """df by checkpoint() in the cluster's spark.checkpoint.dir; where that is unset and all runs on one machine, in a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-checkpoints-"))
    return df.checkpoint(eager=True)
