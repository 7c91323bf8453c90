"""Where intermediate tables may be written."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on one machine may leave it unset; it gets a folder of its own then. On a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tallyspark-"))
    return sc._jsc.sc().getCheckpointDir().get()
