"""Results that are written once before they are read again."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that the session names in ``spark.checkpoint.dir``, and read from there.

    What it has isn't computed again, even if executors are lost, and later plans begin here. Where nothing is named, a folder of
    this machine is made if all runs in one process on it; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="doctax-shared-"))
    return df.checkpoint()
