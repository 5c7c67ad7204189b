"""Tables between the steps of a query, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="attestor-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return _OWN["dir"]


def written(df: DataFrame, label: str) -> DataFrame:
    """Written there and read back, so that what it holds is computed once and a lost executor costs no more than one step."""
    path = f"{root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made
