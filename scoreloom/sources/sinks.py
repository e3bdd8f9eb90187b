"""Sinks (K01 to K09)."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of snapshot folders; run names are text even where they look like numbers.
SNAPSHOT = "value string, part string, run_id string, file string"


def results(rows: DataFrame, folder: str, kinds: tuple[str, ...] = ("parquet",), overwrite: bool = False) -> None:
    """Results.parquet, .jsonl or .csv; refuses to overwrite unless told. An empty frame keeps its columns."""
    mode = "overwrite" if overwrite else "errorifexists"
    for kind in kinds:
        out = rows.write.mode(mode)
        if kind == "parquet":
            out.parquet(f"{folder}/results.parquet")
        elif kind in ("json", "jsonl"):
            out.option("ignoreNullFields", False).json(f"{folder}/results.{kind}")
        elif kind == "csv":
            flat = rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes])
            flat.write.mode(mode).option("header", True).csv(f"{folder}/results.csv")
        else:
            raise ValueError(f"unknown kind: {kind}")


def export(rows: DataFrame, path: str, kind: str) -> None:
    """All filtered rows, neither sorted nor paged."""
    if kind == "csv":
        rows.write.option("header", True).csv(path)
    elif kind == "json":
        rows.write.json(path)
    else:
        raise ValueError(f"unknown kind: {kind}")


def as_json(rows: DataFrame) -> DataFrame:
    """Snapshots and reports, a JSON text a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def snapshots(rows: DataFrame, top: str) -> None:
    """Metrics and config of many runs in one write. rows: run_id, metrics, config (structs).

    Texts go to a folder of this write, by run and file, and only then does the
    manifest name its runs, so that a write that dies half-way shows none of them.
    """
    part = uuid.uuid4().hex
    texts = F.inline(F.array(*[F.struct(F.lit(f).alias("file"), F.to_json(f).alias("value")) for f in ("metrics", "config")]))
    rows.select("run_id", texts).repartition("run_id").write.partitionBy("run_id", "file").text(f"{top}/snapshots/part={part}")
    written = rows.sparkSession.read.option("basePath", f"{top}/snapshots").schema(SNAPSHOT).text(f"{top}/snapshots/part={part}")
    names = written.select("part", "run_id").distinct().withColumn("at", F.lit(datetime.now(timezone.utc)))
    names.write.mode("append").parquet(f"{top}/manifest")


def appended(stream: DataFrame, path: str, checkpoint: str):
    """JSON lines as they come; a batch that fails leaves nothing."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_name(model: str, at: datetime) -> str:
    """K09."""
    return f"{at:%Y%m%d_%H%M%S}_{re.sub('/', '-', model)}"
