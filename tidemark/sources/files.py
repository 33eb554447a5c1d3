"""Readers and writers of the outside formats, each to a typed DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; lines that begin with # are comments."""
    return spark.read.csv(path, header=True, comment="#", schema=schema, enforceSchema=False)


def read_json_batches(spark: SparkSession, path: str, schema: str, most_bytes: int | None = None) -> DataFrame:
    """JSON documents, one a line, gzip or plain; malformed ones in _corrupt. Documents of more than most_bytes are not parsed and come with _too_large."""
    if most_bytes is None:
        return spark.read.schema(f"{schema}, _corrupt string").json(path, multiLine=False, columnNameOfCorruptRecord="_corrupt")
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("_too_large", F.octet_length("value") > most_bytes)
    parsed = F.from_json(F.when(~F.col("_too_large"), F.col("value")), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("x"), "_too_large").select("x.*", "_too_large")


#: Escapes of the text format of COPY, but for the backslash itself.
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _unescaped(cell: Column) -> Column:
    """A cell of COPY's text format; pieces between doubled backslashes hold single ones."""

    def single(piece: Column) -> Column:
        for c, plain in _ESCAPES.items():
            piece = F.replace(piece, F.lit("\\" + c), F.lit(plain))
        return piece

    return F.when(cell != "\\N", F.array_join(F.transform(F.split(cell, r"\\\\", -1), single), "\\"))


def copy_blocks(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """The rows of a table's COPY blocks in plain-text database dumps, as strings; \\N is null, escapes are undone.

    A line's place is its split's place in the file and its number in the split. Blocks are told by their first and last
    lines alone, which are few, and lines find their block by a join; no task sees a whole dump. A line that begins with
    COPY opens a block only if the last one is closed: inside of a block it is data.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value")
    end = F.col("value") == "\\."
    marks = lines.where(F.col("value").startswith("COPY ") | end).withColumn("is_end", end)
    w = Window.partitionBy("file").orderBy("place")
    opens = marks.withColumn("opens", ~F.col("is_end") & F.coalesce(F.lag("is_end").over(w), F.lit(True)))
    close = F.first(F.when(F.col("is_end"), F.col("place")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    name = F.regexp_extract("value", r"^COPY (?:\S+\.)?\"?(\w+)\"? ", 1)
    blocks = opens.withColumn("end", close).where(F.col("opens") & (name == table)).select("file", F.col("place").alias("begin"), "end")
    inside = (lines["place"] > F.col("begin")) & (F.col("end").isNull() | (lines["place"] < F.col("end")))
    rows = lines.join(blocks, "file").where(inside)
    cells = F.split("value", "\t", -1)
    return rows.select(*(_unescaped(F.get(cells, F.lit(i))).alias(c) for i, c in enumerate(columns)))


def aligned(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Older versions of a table: missing columns as null, the rest cast."""
    have = set(df.columns)
    return df.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in schema.items()))


def staged(df: DataFrame, seconds: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """Unix seconds as timestamps, 0 and 1 as booleans."""
    return df.withColumns({c: F.timestamp_seconds(c) for c in seconds} | {c: F.col(c) != 0 for c in flags})


def write_csv(df: DataFrame, path: str, order: list[str], timestamps: tuple[str, ...] = ()) -> None:
    """A CSV with a header, sorted, cells safe for spreadsheets, times as UTC ISO text."""
    from tidemark.functions.scalars import csv_safe

    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    cell: dict[str, Column] = {f.name: csv_safe(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema}
    cell |= {c: iso(c) for c in timestamps}
    df.orderBy(*order).select(*cell.values()).write.mode("overwrite").csv(path, header=True)


def stage(df: DataFrame, path: str, reject: Column, by: str) -> DataFrame:
    """Writes the rows that nothing is wrong with (reject is null) to a stage, partitioned by `by`, and what was rejected and why beside it; by, staged, rejected, first_reason."""
    marked = df.withColumn("_reject", reject)
    marked.write.partitionBy(by).parquet(path)
    back = df.sparkSession.read.schema(marked.schema).parquet(path)
    return back.groupBy(by).agg(F.count_if(F.col("_reject").isNull()).alias("staged"), F.count("_reject").alias("rejected"), F.min("_reject").alias("first_reason"))


def staged_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stage that may be merged."""
    return spark.read.parquet(path).where("_reject is null").drop("_reject")
