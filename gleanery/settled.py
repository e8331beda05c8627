"""Cutting lineage: a table is written to the checkpoint folder and goes on from there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The same rows out of a reliable checkpoint, in the shared folder that spark.checkpoint.dir names.

    Only a session with a local master, as in tests, gets a temporary folder where none is named.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleanery-"))
    return df.checkpoint()
