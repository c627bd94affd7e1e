"""Schemas and the text form of manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row per file or directory.
MANIFEST = "path_type string, permissions string, checksum string, size long, path string"
MANIFEST_COLUMNS = ["path_type", "permissions", "checksum", "size", "path"]
OBJECTS = "checksum string, actual_checksum string, path string"
EVENT_LOG = "event string, id string, location string, created_at timestamp"
HISTORY = "id string, previous_id string, location string, created_at timestamp"
SYSTEM = "version string, created_at timestamp"

#: A well-formed line, with a group for each column; the path is the rest of the line.
LINE = r"^(D|F) ([0-9]+) ([a-f0-9]+) ([0-9]+) (.+)$"


#: Of the library.
VERSION = "2"


def is_id(text: str) -> bool:
    return re.fullmatch("[a-f0-9]{64}", text) is not None


def format_line() -> Column:
    return F.concat_ws(" ", "path_type", "permissions", "checksum", F.col("size").cast("string"), "path")


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Manifest rows of the well-formed lines; comments and anything else are left out."""
    ok = lines.filter(F.col(column).rlike(LINE))
    part = lambda k: F.regexp_extract(column, LINE, k)
    return ok.select(part(1).alias("path_type"), part(2).alias("permissions"), part(3).alias("checksum"), part(4).cast("long").alias("size"), part(5).alias("path"))


def parse_text(spark: SparkSession, text: str) -> DataFrame:
    return parse_lines(spark.createDataFrame([(line,) for line in text.split("\n")], "value string"))


def struct_of(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)


def sorted_lines(manifest: DataFrame) -> DataFrame:
    """The manifest as text lines (column line), in byte order of the paths."""
    return manifest.orderBy("path").select(format_line().alias("line"))
