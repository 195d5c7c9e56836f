"""Shared helpers of the training-data operators.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    It is the one the session names in ``spark.checkpoint.dir``. Only where that is unset and all runs in one process on one
    machine, as in tests, a folder of its own is made and set; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="doctax-shared-")
    context.setCheckpointDir(own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the cluster's own cleaning has the folder
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    It cuts the lineage and survives the loss of executors. Columns and types stay; the row order
    isn't kept. The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dense_groups(columns: list[pa.ChunkedArray | pa.Array]) -> tuple[np.ndarray, int]:
    """A dense number of the group of each row, over the values of several columns; null is a value."""
    combined: np.ndarray | None = None
    size = 1
    for column in columns:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        coded = column.dictionary_encode(null_encoding="encode")
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        width = len(coded.dictionary) + 1
        if combined is None:
            combined, size = index, width
        else:
            combined, size = combined * width + index, size * width
        if size > 1 << 40:
            _, combined = np.unique(combined, return_inverse=True)
            size = int(combined.max()) + 1 if len(combined) else 1
    if combined is None:
        raise ValueError("a group needs at least one column")
    _, inverse = np.unique(combined, return_inverse=True)
    return inverse, int(inverse.max()) + 1 if len(inverse) else 0
