"""Where intermediate tables go.

``spark.checkpoint.dir`` names the folder that the driver and all executors share. It is read
from the session; only where it is unset (local tests) a folder of our own is chosen and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder as a URI or path that Spark's readers and writers understand."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='casewarden-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder name for one run; nothing is ever written into an old one."""
    return f"{shared_root(spark)}/casewarden/{uuid.uuid4().hex}/{name}"


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts the lineage: a lost executor cannot take the rows with it, and no later step
    computes them twice.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
