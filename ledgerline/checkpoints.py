"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in ``spark.checkpoint.dir`` and read back; a lost executor costs a reread.

    A session of one process without the setting gets a temporary folder; on a
    cluster that is an error.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-"))
        root = context._jsc.sc().getCheckpointDir().get()
    path = f"{root}/ledgerline/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
