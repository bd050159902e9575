"""JSON-lines sources and sinks with the checks of an evaluation log."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusops.runtime import written


def read_rows(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file or folder, compressed or not. A malformed line fails a strict read, else it is left out."""
    fields = schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")
    return spark.read.schema(fields).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): lines with the block of their file that a task reads and their place in it. Files are split as any text."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    return written(lines)


def read_positions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line_no, row) with the physical line number from 0 in each file; blank lines count but give no row.

    Lines are numbered within the blocks that tasks read, and the sizes of the blocks before are added, so one long log is read in parallel.
    """
    lines = _lines(spark, path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    starts = lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = lines.withColumn("i", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1).join(starts, ["file", "block"])
    return placed.where(F.trim("value") != "").select("file", (F.col("start") + F.col("i")).cast("int").alias("line_no"), F.from_json("value", schema).alias("row"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an append log; the last line of a file may be cut off, any other malformed line raises an error."""
    lines = _lines(spark, path).where(F.trim("value") != "")
    last = lines.groupBy("file").agg(F.max(F.struct("block", "at")).alias("last"))
    marked = lines.join(last, "file")  # one row for each file
    whole = marked.where(F.try_parse_json("value").isNotNull() | (F.struct("block", "at") != F.col("last")))
    return whole.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a folder that must not exist yet; the commit protocol makes it whole or absent."""
    df.write.mode("errorifexists").format(kind).save(path)


def read_strict(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a log whose every line must be a JSON object with the given fields of the given types; any other line raises an error.

    Types are read as Spark infers them from JSON: string, bigint, double or boolean. Blank lines are errors too.
    """
    kinds = {"string": "STRING", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    lines = spark.read.text(path)
    whole = F.try_parse_json("value")
    found = F.schema_of_variant(whole)
    fine = found.startswith("OBJECT<")
    for name, kind in fields.items():
        fine = fine & found.rlike(rf"[<, ]{name}: {kinds[kind]}[,>]")
    checked = F.when(F.coalesce(fine, F.lit(False)), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("line breaks the contract: "), F.substring("value", 1, 80))).cast("string"))
    return lines.select(F.from_json(checked, ", ".join(f"{n} {k}" for n, k in fields.items())).alias("row")).select("row.*")


def write_staged(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a folder beside its place and renames it when it is whole; a folder that is already there raises an error."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    place, stage = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staged-{uuid.uuid4().hex}"))
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place):
        raise FileExistsError(path)
    df.write.mode("errorifexists").format(kind).save(stage.toString())
    if not files.rename(stage, place):
        files.delete(stage, True)
        raise OSError(f"could not rename to {path}")


def write_manifest(spark: SparkSession, facts: dict, path: str) -> None:
    """One JSON document with sorted keys on any file system that Spark reaches, by a temporary file and a rename."""
    jvm = spark.sparkContext._jvm
    place, stage = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(stage, True)
    out.write(bytearray(json.dumps(facts, sort_keys=True, indent=2, ensure_ascii=False).encode("utf-8")))
    out.close()
    files.delete(place, False)
    if not files.rename(stage, place):
        raise OSError(f"could not rename to {path}")
