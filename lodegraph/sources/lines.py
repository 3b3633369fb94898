"""Line-framed sources: newline-delimited JSON and server-sent events, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ndjson(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed rows of ``lines`` (value); lines that are no JSON are dropped."""
    parsed = lines.select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    good = parsed.where(F.col("j").isNotNull() & F.col("j._bad").isNull()).select("j.*").drop("_bad")
    return good.dropna("all")


def write_ndjson(rows: DataFrame, path: str) -> None:
    """One JSON object per row and line; null fields are left out."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def ndjson_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return ndjson(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), schema)


def server_events(lines: DataFrame, by: str, order: str) -> DataFrame:
    """by, event, data: blank lines end an event, data lines join by line ends, comments are skipped.

    ``lines``: by (a stream's key), order (a line's number), value.
    """
    blank = (F.col("value") == "").cast("int")
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = lines.withColumn("n", F.coalesce(F.sum(blank).over(before), F.lit(0)))
    field = F.regexp_extract("value", r"^([^:]*)", 1)
    value = F.regexp_replace(F.regexp_extract("value", r"^[^:]*:(.*)$", 1), "^ ", "")
    said = numbered.where((F.col("value") != "") & ~F.startswith("value", F.lit(":")))
    data = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(field == "data", F.struct(F.col(order).alias("o"), value.alias("v"))))), lambda x: x["v"]),
        "\n",
    )
    name = F.max_by(F.when(field == "event", value), F.when(field == "event", F.col(order)))
    return said.groupBy(by, "n").agg(F.coalesce(name, F.lit("message")).alias("event"), data.alias("data")).where("data <> ''")
