"""Run logs and result tables of the harness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_log(lines: DataFrame, prefix: str = "") -> DataFrame:
    """(program, throughput) of ordered lines (source, pos, line).

    A line with ``compile`` starts a program, its last word; a later line with
    ``Throughput`` gives the program's value, the last word but one.  A program
    without one keeps a null, so that no value moves to another program.
    """
    text = F.trim("line")
    words = F.split(text, r"\s+")
    rows = lines.withColumns({"starts": F.col("line").contains("compile").cast("int"), "value": F.when(F.col("line").contains("Throughput"), F.try_element_at(words, F.lit(-2)).try_cast("double"))})
    rows = rows.withColumn("run", F.sum("starts").over(Window.partitionBy("source").orderBy("pos")))
    rows = rows.withColumn("name", F.when(F.col("starts") == 1, F.element_at(words, -1)))
    runs = rows.where("run > 0").groupBy("source", "run").agg(F.max("name").alias("name"), F.min_by("value", F.when(F.col("value").isNotNull(), F.col("pos"))).alias("throughput"))
    return runs.select(F.concat(F.lit(prefix), F.col("name")).alias("program"), "throughput")


def read_logs(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Log files of a path; lines of a file keep their order, also where it is read in several splits."""
    lines = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return parse_log(lines.select(F.col("_metadata.file_path").alias("source"), place.alias("pos"), F.col("value").alias("line")), prefix)


def write_logs(lines: DataFrame, path: str) -> None:
    """One text file of the lines (pos, line), in order."""
    lines.coalesce(1).sortWithinPartitions("pos").select("line").write.text(path)


def read_results(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(filename, throughput) of a result CSV; quoted names may hold line ends, which go."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    return raw.select(F.trim(F.regexp_replace("filename", r"[\r\n]+", "")).alias("filename"), F.col(f"`{column}`").try_cast("double").alias("throughput"))


def write_results(results: DataFrame, path: str, column: str, mode: str = "error", name: str = "filename") -> None:
    """Rows to a CSV folder, all values quoted, so that names may hold line ends; ``mode`` append adds to it."""
    out = results.select(F.col(name).alias("filename"), F.col("throughput").alias(column))
    out.write.mode(mode).option("header", True).option("quoteAll", True).csv(path)


def append_results(results: DataFrame, path: str, column: str) -> None:
    """Add rows (program, throughput) to a CSV folder, all values quoted."""
    write_results(results, path, column, "append", "program")
