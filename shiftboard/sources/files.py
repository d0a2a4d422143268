"""Reading files and tables with declared schemas; writing result bundles."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..session import pin
from . import manifest

#: about 100 bytes each
MOST_BROADCAST_BLOCKS = 500_000


def _csv(spark: SparkSession, path: str, schema: StructType | str, header: bool, **options: str) -> DataFrame:
    reader = spark.read.schema(schema).option("header", header).option("enforceSchema", False)
    return reader.options(**options).csv(path)


def csv_scan(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """CSV with a declared schema; a header that disagrees with it raises."""
    return _csv(spark, path, schema, header)


def csv_null_marker(
    spark: SparkSession, path: str, schema: StructType | str, null_value: str, header: bool = True
) -> DataFrame:
    """CSV in which ``null_value`` (leading blanks aside) stands for a missing value."""
    return _csv(spark, path, schema, header, nullValue=null_value, ignoreLeadingWhiteSpace="true")


def csv_parse_dates(
    spark: SparkSession, path: str, schema: StructType | str, date_format: str, header: bool = True
) -> DataFrame:
    """CSV whose DATE columns are written in ``date_format``."""
    return _csv(spark, path, schema, header, dateFormat=date_format)


def table_scan(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by its one-, two- or three-part name."""
    return spark.table(name)


def inline_config(spark: SparkSession, rows: Sequence[tuple[Any, ...]], schema: StructType | str) -> DataFrame:
    """A small constant relation, held in the plan itself."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def with_row_id(d: DataFrame, name: str = "row_id") -> DataFrame:
    """Dense 0-based row number in file order: path, block in the file, row in the block.

    ``d`` must read files directly.  Rows are numbered where they are read, in a first pass that keeps one count per file
    block (stored) and a second that adds the block's place; no row moves.  Which task reads a block does not matter.
    Should the second pass cut a file into other blocks than the first, as it may if the session's cores change
    in between (``spark.sql.files.minPartitionNum`` prevents it), a block without a known start raises, and so does one of
    another length: no row is lost or numbered wrongly.
    """
    read = d.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.col("_metadata.file_block_length").alias("__length"),
        F.monotonically_increasing_id().alias("__id"),
    )
    counted = read.groupBy("__file", "__block").agg(
        F.count("*").alias("__n"), F.min("__id").alias("__first"), F.max("__length").alias("__held")
    )
    counted = pin(counted)
    starts = block_starts(counted)
    starts = F.broadcast(starts) if counted.count() <= MOST_BROADCAST_BLOCKS else starts
    return numbered(read, starts, name).select(*d.columns, name)


def block_starts(counted: DataFrame) -> DataFrame:
    """The rows before each file block, from their counts: one row per block."""
    earlier = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(earlier), F.lit(0))
    return counted.select("__file", "__block", "__first", "__held", before.alias("__start"))


def numbered(read: DataFrame, starts: DataFrame, name: str) -> DataFrame:
    """Rows with their number; each must be of a block that has a start."""
    joined = read.join(starts, ["__file", "__block"], "left")
    start = F.when(F.col("__held") == F.col("__length"), F.col("__start")).otherwise(
        F.raise_error(F.concat(F.lit("files are cut otherwise than when they were counted: "), "__file", F.lit(" at "), F.col("__block").cast("string")))
    )
    return joined.withColumn(name, start + F.col("__id") - F.col("__first"))


def skip_leading_rows(d: DataFrame, n: int, name: str = "row_id") -> DataFrame:
    """Drop the first ``n`` data rows in file order and renumber the rest from 0."""
    return with_row_id(d, name).filter(F.col(name) >= n).withColumn(name, F.col(name) - n)


def bundle_sink(
    frames: Mapping[str, DataFrame],
    directory: str,
    format: str = "parquet",
    mode: str = "overwrite",
    partition_by: Mapping[str, Sequence[str]] | None = None,
) -> None:
    """Write named results as one bundle: all of them, or none.

    Each result gets a folder of its own; the manifest that names them is replaced last (``manifest``).  If one fails, the bundle
    before it stays as it was.  ``mode``: ``overwrite``, or ``append`` to the rows of results that the bundle holds.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode is overwrite or append, not {mode}")
    if not frames:
        raise ValueError("a bundle holds at least one result")
    spark = next(iter(frames.values())).sparkSession
    held = (manifest.read(spark, directory) or {}) if mode == "append" else {}
    if held and held["format"] != format:
        raise ValueError(f"the bundle is written as {held['format']}")
    parts, schemas = dict(held.get("parts", {})), dict(held.get("schemas", {}))
    version = manifest.new_version(directory)
    for name, frame in frames.items():
        writer = frame.write.format(format)
        if format == "csv":
            writer = writer.option("header", True)
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        schemas.setdefault(name, frame.schema.json())
        if _schema(schemas[name]).simpleString() != frame.schema.simpleString():
            raise ValueError(f"{name} has other columns than in the bundle")
        path = posixpath.join(version, name)
        writer.save(path)
        parts[name] = [*parts.get(name, []), posixpath.relpath(path, directory)]
    manifest.commit(spark, directory, {"format": format, "parts": parts, "schemas": schemas})


def _schema(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))


def read_bundle(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The results of the newest whole bundle, by name, with the columns they were written with."""
    held = manifest.read(spark, directory)
    if held is None:
        raise FileNotFoundError(f"no bundle in {directory}")
    out = {}
    for name, paths in held["parts"].items():
        schema = _schema(held["schemas"][name])
        reader = spark.read.format(held["format"]).schema(schema)
        if held["format"] == "csv":
            reader = reader.option("header", True)
        # each folder is a base of its own for partition columns
        frames = [reader.load(posixpath.join(directory, p)).select(schema.names) for p in paths]
        out[name] = reduce(DataFrame.unionByName, frames)
    return out
