"""Readers: observation CSV files with a free-text preamble, JSON lines, JSON arrays, saved tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.config import COLUMNS, Channel, Config

#: Cells that stand for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files with file and n, an order of the lines in each: the split's place in the file, then the line's in the
    split. Files are read in splits, a line at a time.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line")).alias("n"), F.col("value").alias("line"))
    return lines.withColumn("line", F.regexp_replace("line", "\r$", ""))


def _starts(lines: DataFrame, header: str) -> DataFrame:
    """One row a file: file and the n of its table's header, null if it has none."""
    return lines.groupBy("file").agg(F.min(F.when(F.lower("line").startswith(header), F.col("n"))).alias("start"))


def read_raw(spark: SparkSession, path: str, columns: Sequence[str] = COLUMNS, header: str = "date,") -> DataFrame:
    """String columns by position, with file and n (ordered as the lines are). In each file the table starts after the first line that
    begins with ``header`` in any case; a file without one is an error. Cells are trimmed, missing ones null; short lines are filled
    with nulls.
    """
    lines = _lines(spark, path)
    start = _starts(lines, header)
    missing = F.raise_error(F.concat(F.lit("no table header in "), "file")).cast(start.schema["start"].dataType)
    start = start.withColumn("start", F.when(F.col("start").isNull(), missing).otherwise(F.col("start")))
    rows = lines.join(F.broadcast(start), "file").filter((F.col("n") > F.col("start")) & (F.trim("line") != ""))
    cells = F.split("line", ",", -1)
    clean = lambda c: F.when(~F.coalesce(F.trim(c), F.lit("")).isin(*MISSING), F.trim(c))
    return rows.withColumn("_c", cells).select("file", "n", *[clean(F.get("_c", F.lit(i))).alias(c) for i, c in enumerate(columns)])


def read_preamble(spark: SparkSession, path: str, header: str = "date,") -> DataFrame:
    """The lines before the table of each file: file, n, line."""
    lines = _lines(spark, path)
    return lines.join(F.broadcast(_starts(lines, header)), "file").filter(F.col("start").isNull() | (F.col("n") < F.col("start"))).select("file", "n", "line")


def parse_time(c, pattern: str = "dd-MMM-yyyy HH:mm"):
    """A time without zone; month names in any case; null if it can't be read."""
    return F.try_to_timestamp(F.initcap(c), F.lit(pattern)).cast("timestamp_ntz")


def read_observations(spark: SparkSession, path: str, config: Config = Config(), mask: bool = True, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """ts, a double per channel, and the flags as integers.

    Rows without a readable time go; of rows with one time the first in file order stays. Numbers that can't be read are
    null; columns that the source lacks are null. With ``mask``, values whose flag is missing or above 2 are null.
    """
    raw = read_raw(spark, path, columns).withColumn("ts", parse_time(F.col("date"))).filter("ts is not null")
    first = F.row_number().over(Window.partitionBy("ts").orderBy("file", "n"))
    raw = raw.withColumn("_r", first).filter("_r = 1")
    have = set(columns)

    def number(name: str | None):
        return F.expr(f"try_cast(`{name}` as double)") if name in have else F.lit(None).cast("double")

    flags = {c.flag: number(c.flag).cast("int").alias(c.flag) for c in config.channels if c.flag}
    out = raw.select("ts", *[number(c.column).alias(c.name) for c in config.channels], *flags.values())
    return masked(out, config.channels, config.highest_flag) if mask else out


def masked(wide: DataFrame, channels: Sequence[Channel], highest: int = 2) -> DataFrame:
    from tidemark.operators.signal import quality_masked

    return quality_masked(wide, [(c.name, c.flag) for c in channels if c.flag], highest)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, compressed or not (by suffix). Blank lines are skipped; a line that is no object of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array of objects each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def existing(spark: SparkSession, path: str) -> str:
    """``path``, or path.gz if only that exists; asked of the file system that holds it."""
    jvm = spark.sparkContext._jvm
    for p in (path, path + ".gz"):
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return p
    raise FileNotFoundError(path)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A saved table; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def labels_of(prototypes: DataFrame) -> DataFrame:
    """window_id, pattern_id from prototypes with arrays of their members."""
    return prototypes.select(F.explode("members").alias("window_id"), "pattern_id")


def read_physics_context(windows: DataFrame) -> DataFrame:
    """window_id, channel_stds, channel_x0 of windows that have deviations; other columns aren't read."""
    return windows.select("window_id", "channel_stds", "channel_x0").filter(F.size("channel_stds") > 0)
