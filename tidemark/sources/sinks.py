"""Writers: tables as Parquet, their text forms, summaries and manifests."""

from __future__ import annotations

import datetime as dt
import json
import math
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Without the setting a local session gets a fresh one of its own; a cluster,
    whose machines share no temporary folder, an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/tidemark/{uuid.uuid4().hex}"


def write_lines(df: DataFrame, path: str, order: str, head: Sequence[str] = ()) -> None:
    """The column ``line`` as text files, in order within each and over their names; every file begins with the lines of ``head``.

    Rows are split by ranges of the order, so no task holds more than its range.
    """
    lines = df.repartitionByRange(order).sortWithinPartitions(order)
    own = F.array("line")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's number in its partition
    top = F.when(place == 0, F.concat(F.array(*[F.lit(x) for x in head]), own)).otherwise(own) if head else own
    lines.select(top.alias("lines")).select(F.explode("lines").alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_json_lines(df: DataFrame, path: str, compressed: bool = True, mode: str = "overwrite") -> None:
    """One object a line. NaN is no JSON: it is written as a missing field."""
    clean = df.select(*[F.nanvl(c, F.lit(None)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    clean.write.mode(mode).option("compression", "gzip" if compressed else "none").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays as comma-separated text, with nothing for a null entry; maps and structs as JSON."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind.startswith("array<") and not kind.startswith(("array<struct", "array<array", "array<map")):
            c = F.concat_ws(",", F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit(""))))
        elif kind.startswith(("struct", "map", "array")):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).option("header", True).csv(path)


def plain(x):
    """Values as JSON knows them: NaN and infinities become null."""
    if is_dataclass(x):
        return plain(asdict(x))
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, (dt.date, dt.datetime)):
        return x.isoformat()
    return x


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file where ``path`` is, be it local or not."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_summary(df: DataFrame, path: str) -> dict:
    """The first row of an aggregate as a JSON object."""
    row = df.first()
    summary = plain(row.asDict(recursive=True)) if row else {}
    write_text(df.sparkSession, json.dumps(summary, indent=2, default=str), path)
    return summary


def write_manifest(spark: SparkSession, path: str, config, **more) -> dict:
    """What a run was asked to do: its configuration, Spark's version and settings that shape plans."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.session.timeZone")
    out = plain({"config": config, "spark": spark.version, "settings": {k: spark.conf.get(k, None) for k in keys}, **more})
    write_text(spark, json.dumps(out, indent=2, default=str), path)
    return out


def write_observed(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), **measures: Column) -> dict:
    """Write a table and return aggregates of its rows (by default their number), which are made as the rows are written: one pass."""
    seen = Observation()
    names = measures or {"rows": F.count(F.lit(1))}
    write_table(df.observe(seen, *[c.alias(k) for k, c in names.items()]), path, partition_by)
    return plain(seen.get)


def write_bundle(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Each table as Parquet under its name; the row counts, taken while writing."""
    return {name: write_observed(df, f"{folder}/{name}")["rows"] for name, df in tables.items()}


def write_samples(samples: DataFrame, path: str) -> dict:
    """Sequence samples as a table, and their summary beside it: how many, the longest history and the most targets. One pass."""
    summary = write_observed(samples, path, n_samples=F.count(F.lit(1)), max_history=F.max(F.size("history_ids")), max_target_count=F.max(F.size("target_ids")))
    write_text(samples.sparkSession, json.dumps(summary, indent=2), f"{path.rstrip('/')}.summary.json")
    return summary
