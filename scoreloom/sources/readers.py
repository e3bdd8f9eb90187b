"""Scans and registries."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .sinks import SNAPSHOT

REQUIRED = tuple(x.strip("` ").split(" ")[0].strip("`") for x in schemas.QUESTIONS.split(", "))


def exists(spark: SparkSession, path: str) -> bool:
    """By Hadoop's file systems, so any store will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def require(rows: DataFrame, names: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Fails on missing columns, by name."""
    if lost := sorted(set(names) - set(rows.columns)):
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return rows


def questions(spark: SparkSession, path: str, names: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Keys as text, other columns kept."""
    rows = require(spark.read.parquet(path), names)
    return rows.withColumns({c: F.col(c).cast("string") for c in ("id", "problem_number", "group") if c in rows.columns})


def resolved(spark: SparkSession, path: str, roots: tuple[str, ...] = (".", "datasets")) -> str:
    """The path as given, or under one of the roots; must end in .parquet."""
    given = os.path.expanduser(path)
    if not given.endswith(".parquet"):
        raise ValueError(f"not a parquet file: {path}")
    for p in [given, *[f"{r}/{given}" for r in roots], *[f"{r}/{os.path.basename(given)}" for r in roots]]:
        if exists(spark, p):
            return p
    raise FileNotFoundError(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped, a bad line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S05."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def run_results(spark: SparkSession, folder: str, order: tuple[str, ...] = ("parquet", "jsonl", "json")) -> DataFrame:
    """The first of the result files that there is; K-side readers may give another order."""
    readers = {"parquet": lambda p: spark.read.parquet(p), "jsonl": lambda p: jsonl(spark, p, schemas.RESULTS), "json": lambda p: json_array(spark, p, schemas.RESULTS)}
    for kind in order:
        path = f"{folder}/results.{kind}"
        if exists(spark, path):
            rows = readers[kind](path)
            if "warnings" in rows.columns and dict(rows.dtypes)["warnings"] == "string":  # a bare text counts as one warning
                rows = rows.withColumn("warnings", F.when(F.col("warnings").isNotNull(), F.array("warnings")))
            return rows.withColumn("results_source", F.lit(kind))
    raise FileNotFoundError(f"no results under {folder}")


def runs(spark: SparkSession, top: str) -> DataFrame:
    """One row for each folder with both metrics.json and config.json."""
    run_id = F.regexp_extract(F.input_file_name(), r"([^/]+)/(?:metrics|config)\.json", 1)
    metrics = spark.read.schema(schemas.METRICS).option("multiLine", True).json(f"{top}/*/metrics.json").withColumn("run_id", run_id)
    config = spark.read.schema(schemas.CONFIG).option("multiLine", True).json(f"{top}/*/config.json").withColumn("run_id", run_id)
    pack = lambda df, name: df.select("run_id", F.struct(*[c for c in df.columns if c != "run_id"]).alias(name))
    return pack(metrics, "metrics").join(pack(config, "config"), "run_id").orderBy("run_id")


def snapshots(spark: SparkSession, top: str) -> DataFrame:
    """S07 of sinks.snapshots(): run_id, metrics, config of the runs that the manifest names and that have both; of a run written twice the last."""
    last = spark.read.schema("part string, run_id string, at timestamp").parquet(f"{top}/manifest").groupBy("run_id").agg(F.max_by("part", F.struct("at", "part")).alias("part"))
    texts = spark.read.schema(SNAPSHOT).text(f"{top}/snapshots").join(last, ["run_id", "part"], "left_semi")
    of = lambda f, shape: F.from_json(F.max(F.when(F.col("file") == f, F.col("value"))), shape).alias(f)
    return texts.groupBy("run_id").agg(of("metrics", schemas.METRICS), of("config", schemas.CONFIG)).where("metrics is not null and config is not null").orderBy("run_id")


def invariants() -> dict[str, Column]:
    """What must hold of a baseline."""
    ids = F.transform("grades", lambda g: g["id"])
    values = F.map_values("counts_by_grade")
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, b: a + b)
    ranges = F.concat(F.transform("bins", lambda b: b["range_default"]), F.flatten(F.transform("bins", lambda b: F.coalesce(F.map_values(b["ranges_by_grade"]), F.array()))))
    return {
        "version": F.col("schema_version") == "2.0",
        "bins": F.size("bins") >= 1,
        "lengths": F.forall(values, lambda v: F.size(v) == F.size("bins")),
        "totals": F.forall(F.map_entries("counts_by_grade"), lambda e: total(e["value"]) == F.try_element_at(F.col("totals_by_grade"), e["key"])),
        "grades": F.size(F.array_except(F.map_keys("counts_by_grade"), ids)) == 0,
        "ranges": F.forall(ranges, lambda r: (r["min"] <= r["max"]) & F.coalesce(r["inclusive"], F.lit("both")).isin("left", "right", "both")),
        "members": F.forall("grades", lambda g: F.size(g["members"]) > 0),
    }


def baselines(spark: SparkSession, top: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Baselines that hold, and (path, broken rules) of the others; strict fails on any of those."""
    rows = spark.read.schema(f"{schemas.BASELINE}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(f"{top}/human_baseline_*.json").withColumn("path", F.input_file_name())
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in invariants().items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("broken", broken)
    bad = marked.where(F.size("broken") > 0).select("path", "broken")
    if strict and (first := bad.first()):
        raise ValueError(f"{first.path}: {', '.join(first.broken)}")
    return marked.where(F.size("broken") == 0).drop("broken", "_corrupt"), bad


def baseline_bins(rows: DataFrame) -> DataFrame:
    """year, grade, idx, lo, hi, n: a baseline's bins with each grade's own ranges."""
    counts = rows.select("year", "bins", F.explode("counts_by_grade").alias("grade", "counts"))
    each = counts.select("year", "grade", F.posexplode(F.arrays_zip("bins", "counts")).alias("idx", "b"))
    own = F.coalesce(F.try_element_at(F.col("b.bins.ranges_by_grade"), F.col("grade")), F.col("b.bins.range_default"))
    return each.select("year", "grade", "idx", own["min"].alias("lo"), own["max"].alias("hi"), F.col("b.counts").alias("n"))


def human_performance(spark: SparkSession, path: str) -> DataFrame:
    """question_id, p_correct, sample_size; empty where it can't be read."""
    shape = "question_id string, p_correct double, sample_size bigint"
    if not exists(spark, path):
        return spark.createDataFrame([], shape)
    rows = spark.read.parquet(path)
    return rows.select(F.col("question_id").cast("string").alias("question_id"), "p_correct", "sample_size") if {"question_id", "p_correct", "sample_size"} <= set(rows.columns) else spark.createDataFrame([], shape)


def lookup(rows: DataFrame, key: str, value: str, columns: list[str]) -> DataFrame:
    """The filter and the columns reach the scan."""
    return rows.where(F.col(key) == value).select(*columns)


def any_table(spark: SparkSession, path: str, schema: str = schemas.RESULTS) -> DataFrame:
    """Parquet, JSON array or JSON lines by the file's ending."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".jsonl"):
        return jsonl(spark, path, schema)
    if path.endswith(".json"):
        return json_array(spark, path, schema)
    raise ValueError(f"neither parquet nor JSON: {path}")


def config(text: str, kind: str = "json") -> dict:
    """JSON, or YAML where that library is at hand."""
    if kind in ("yaml", "yml"):
        try:
            import yaml
        except ImportError:
            raise RuntimeError("reading YAML needs the yaml library") from None
        return yaml.safe_load(text) or {}
    return json.loads(text)


def models(spark: SparkSession, path: str) -> DataFrame:
    """One row a model with its least interval between requests."""
    rows = spark.read.schema(schemas.MODELS).option("multiLine", True).json(path).select(F.explode("models").alias("m"))
    limit = F.col("m.rate_limit")
    interval = F.coalesce(limit["min_interval_seconds"], F.try_divide(F.lit(1.0), limit["requests_per_second"]), F.try_divide(F.lit(60.0), limit["requests_per_minute"]))
    return rows.select("m.id", "m.label", F.coalesce("m.supports_vision", F.lit(False)).alias("supports_vision"), interval.alias("min_interval"))


def failures(spark: SparkSession, path: str) -> DataFrame:
    """The log has no message and no time of its own; they are null here."""
    return jsonl(spark, path, schemas.FAILURES).select("id", F.lit(None).cast("string").alias("message"), F.lit(None).cast("timestamp").alias("timestamp"), "error", "status_code", "attempts")


def pick_runs(runs_: DataFrame, wanted: list[str] | None = None, latest: int = 5) -> DataFrame:
    """The runs asked for (all must be there), or the latest by name."""
    if wanted:
        found = runs_.where(F.col("run_id").isin(*wanted))
        names = {r.run_id for r in found.select("run_id").distinct().collect()}  # at most as many as were asked for
        if lost := sorted(set(wanted) - names):
            raise ValueError(f"unknown runs: {', '.join(lost)}")
        return found
    return runs_.orderBy(F.desc("run_id")).limit(latest)


def dotenv(path: str, env: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines, `export` and quotes allowed; what is set stays."""
    out = dict(env)
    for line in Path(path).read_text().splitlines():
        line = line.strip().removeprefix("export ").strip()
        if line and not line.startswith("#") and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            out.setdefault(key, value.strip("\"'"))
    return out
