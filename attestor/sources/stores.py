"""Logs, splits, cache, runs and recorded answers on disk; sinks for results."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BackendError, ValidationError
from ..operators.gold import with_seq
from ..operators.scoring import CACHE_SCHEMA
from . import files

GOLD = "seq long, item_id string, code_id string, label int, coder string, timestamp string, split string, stratum string, inclusion_probability double, model_visible boolean, sample_seed long"
REVIEW = "seq long, item_id string, code_id string, label int, coder string, timestamp string, probability double, model_visible boolean"


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S+00:00")


def new_run_id() -> str:
    """Names sort by time; two runs of one second differ."""
    return f"{datetime.now(UTC):%Y%m%dT%H%M%S%fZ}-{uuid.uuid4().hex[:6]}"


class Log:
    """Append-only JSON lines; `seq` keeps the order of writing."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        if not files.exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json(self.path, mode="FAILFAST")

    def append(self, rows: list[dict] | DataFrame) -> None:
        base = self.read().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        if isinstance(rows, list):
            names = [x.split()[0] for x in self.schema.split(", ")]
            rows = self.spark.createDataFrame([tuple(base + k + 1 if c == "seq" else r.get(c) for c in names) for k, r in enumerate(rows)], self.schema)
        elif "seq" not in rows.columns:
            rows = with_seq(rows, base)
        bad = rows.where("label NOT IN (0, 1) OR item_id IS NULL OR code_id IS NULL").take(1)
        if bad:
            raise ValidationError(f"labels are 0 or 1: {bad[0]}")
        rows.write.mode("append").json(self.path)

    def purge(self) -> None:
        files.delete(self.spark, self.path)


def gold_log(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, GOLD)


def review_log(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, REVIEW)


def save_splits(splits: DataFrame, path: str, *, seed: int, corpus_hash: str, fractions: dict) -> None:
    """Parquet of the assignment and a JSON note beside it."""
    splits.write.mode("overwrite").parquet(path)
    spark = splits.sparkSession
    counts = {r["split"]: r["count"] for r in spark.read.parquet(path).groupBy("split").count().collect()}
    files.write_json(spark, path + ".json", {"version": 1, "seed": seed, "corpus_hash": corpus_hash, "created_at": now(), "fractions": fractions, "counts": counts})


def load_splits(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    note = files.read_json(spark, path + ".json")
    splits = spark.read.parquet(path)
    if not {"item_id", "split"} <= set(splits.columns):
        raise ValidationError(f"{path} holds no split assignment")
    return splits, note


def require_corpus(note: dict, corpus_hash: str) -> None:
    if note["corpus_hash"] != corpus_hash:
        raise ValidationError("the corpus changed since it was split", hint="splits reset")


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Whole versions of a table, oldest first: Spark marks a table once it is committed."""
    return [f"{path}/{n}" for n in files.names(spark, path) if files.exists(spark, f"{path}/{n}/_SUCCESS")]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    held = _versions(spark, path)
    return spark.read.schema(CACHE_SCHEMA).parquet(held[-1]) if held else spark.createDataFrame([], CACHE_SCHEMA)


def write_cache(cache: DataFrame, path: str) -> None:
    """A new version, which readers take once it is whole; only then the older ones go."""
    spark = cache.sparkSession
    cache.write.parquet(f"{path}/{new_run_id()}")
    for old in _versions(spark, path)[:-1]:
        files.delete(spark, old)


def save_run(scores: DataFrame, failures: DataFrame, runs_dir: str, manifest: dict) -> str:
    run, spark = f"{runs_dir}/{manifest['run_id']}", scores.sparkSession
    scores.write.mode("overwrite").parquet(f"{run}/scores")
    if not failures.isEmpty():
        failures.write.mode("overwrite").parquet(f"{run}/failures")
    files.write_json(spark, f"{run}/manifest.json", {"version": 1, **manifest})
    return run


def latest_run(spark: SparkSession, runs_dir: str, purpose: str | None = None) -> str | None:
    """The newest run by name; a manifest without purpose is a `run`."""
    for name in reversed(files.names(spark, runs_dir)):
        note = f"{runs_dir}/{name}/manifest.json"
        if files.exists(spark, note) and (purpose is None or files.read_json(spark, note).get("purpose", "run") == purpose):
            return f"{runs_dir}/{name}"
    return None


def save_calibration(checks: DataFrame, path: str, note: dict) -> list[dict]:
    """One row a code reaches the driver and the file."""
    rows = [r.asDict() for r in checks.collect()]
    files.write_json(checks.sparkSession, path, {"version": 1, "created_at": now(), **note, "codes": {r["code_id"]: r for r in rows}})
    return rows


def load_calibration(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    note = files.read_json(spark, path)
    rows = [(k, v.get("t_lo"), v.get("t_hi"), v.get("verdict"), v.get("coverage"), v.get("kappa")) for k, v in note["codes"].items()]
    return spark.createDataFrame(rows, "code_id string, t_lo double, t_hi double, verdict string, coverage double, kappa double"), note


def read_recorded(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """item_hash, code_id, probability and the model version from {model_version, probabilities: {hash: {code: p}}} or the bare table."""
    if not files.exists(spark, path):
        raise BackendError(f"no recorded probabilities at {path}")
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.get_json_object("value", "$.model_version").alias("model"), F.coalesce(F.get_json_object("value", "$.probabilities"), F.col("value")).alias("table"))
    table = F.from_json("table", "map<string, map<string, double>>")
    rows = parsed.select(F.explode(table).alias("item_hash", "codes")).select("item_hash", F.explode("codes").alias("code_id", "probability"))
    return rows, parsed.select("model").first()["model"] or "recorded"


SUFFIX = {"csv": "csv", "parquet": "parquet", "stata": "dta", "spss": "sav", "json": "json"}


def default_filename(name: str, fmt: str) -> str:
    if fmt not in SUFFIX:
        raise ValidationError(f"unknown format {fmt!r}", hint=", ".join(SUFFIX))
    return f"{name}.{SUFFIX[fmt]}"


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """csv, parquet and json in parallel as a folder of parts; stata and spss through the driver, one file."""
    default_filename("", fmt)
    if fmt in ("csv", "json", "parquet"):
        writer = df.write.mode("overwrite")
        {"csv": lambda: writer.csv(path, header=True), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[fmt]()
        return
    frame = df.toPandas()
    if fmt == "spss":
        try:
            import pyreadstat
        except ImportError as e:
            raise ValidationError("spss output needs pyreadstat") from e
        pyreadstat.write_sav(frame, path)
        return
    frame.columns = [c.replace(".", "_")[:32] for c in frame.columns]
    for c in frame.columns:
        if str(frame[c].dtype) in ("Int32", "Int64", "int32", "int64"):
            frame[c] = frame[c].astype("float64")
        elif frame[c].dtype == object:
            frame[c] = frame[c].fillna("").astype(str)
    frame.to_stata(path, version=118, write_index=False)
