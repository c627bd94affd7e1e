"""Merkle rollup of a file relation into directories, and ids of whole manifests.

The checksum of a directory is the digest of its direct children's distinct checksums in sorted order,
without separators; its size is the sum of its children's sizes, equal ones included. Names and
permissions count in the manifest's id only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blake3 import Span
from ..functions.blake3 import combine as combine_spans
from ..functions.hashing import digest
from ..lineage import checkpoint
from ..schema import MANIFEST_COLUMNS, format_line

#: Levels after which the lineage is cut.
CUT_EVERY = 8


def parent(path: Column) -> Column:
    """The directory of a file or directory path, with a closing slash; the root has none."""
    return F.when(path.isin("./", "/"), F.lit(None)).otherwise(F.regexp_replace(path, r"[^/]+/?$", ""))


def depth(path: Column) -> Column:
    """How many directories a directory path has."""
    return F.size(F.split(path, "/")) - 1


def ancestors(files: DataFrame) -> DataFrame:
    """All directories above the files' paths (column path), each once."""
    parts = F.split(F.regexp_replace("path", r"[^/]*$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    return files.select(F.explode(prefixes).alias("path")).distinct()


def _level(children: DataFrame, algorithm: str, context: str | None) -> DataFrame:
    """path, checksum and size of the parents of ``children`` (parent, checksum, size)."""
    # the digest is of an aggregate, so it is a projection above it
    summed = children.groupBy("parent").agg(F.array_join(F.array_sort(F.collect_set("checksum")), "").alias("joined"), F.sum("size").alias("size"))
    return summed.select(F.col("parent").alias("path"), digest(F.col("joined"), algorithm, context).alias("checksum"), "size")


def _streamed_level(children: DataFrame, algorithm: str) -> DataFrame:
    """As ``_level``, for directories of very many entries: the digest is fed in sorted order, no group is held."""
    sizes = children.groupBy("parent").agg(F.sum("size").alias("size"))
    distinct = children.select("parent", "checksum").distinct().repartition("parent").sortWithinPartitions("parent", "checksum")

    def fed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, hasher = None, None
        for frame in frames:
            out = []
            for name, checksum in zip(frame["parent"], frame["checksum"]):
                if name != at:
                    if hasher is not None:
                        out.append((at, hasher.hexdigest()))
                    at, hasher = name, hashlib.new(algorithm)
                hasher.update(checksum.encode())
            if out:
                yield pd.DataFrame(out, columns=["path", "checksum"])
        if hasher is not None:
            yield pd.DataFrame([(at, hasher.hexdigest())], columns=["path", "checksum"])

    digests = distinct.mapInPandas(fed, "path string, checksum string")
    return digests.join(sizes.withColumnRenamed("parent", "path"), "path")


def rollup(files: DataFrame, dirs: DataFrame | None = None, algorithm: str = "sha256", context: str | None = None, file_mode: str = "600", dir_mode: str = "700", streamed: bool = False) -> DataFrame:
    """The whole manifest of ``files`` (path, checksum, size and perhaps permissions).

    dirs: directory paths with a closing slash (and perhaps permissions), for empty ones too; by default
    the files' ancestors. Directories roll up into listed ones only. Each file row is shuffled once, at
    its own level. ``streamed`` is for directories whose distinct digests are too many for one row
    (built-in digests only).
    """
    if "permissions" not in files.columns:
        files = files.withColumn("permissions", F.lit(file_mode))
    # every level reads the files' rows; this way their contents are read and hashed once
    files = checkpoint(files.select("path", "permissions", "checksum", F.col("size").cast("long").alias("size")))
    dirs = ancestors(files) if dirs is None else dirs
    if "permissions" not in dirs.columns:
        dirs = dirs.withColumn("permissions", F.lit(dir_mode))
    dirs = checkpoint(dirs.select("path", "permissions", depth(F.col("path")).alias("depth"), parent(F.col("path")).alias("parent")))
    leaves = files.select(parent(F.col("path")).alias("parent"), "checksum", "size")
    leaves = leaves.withColumn("depth", depth(F.col("parent")))
    empty = digest(F.lit(""), algorithm, context)
    rolled: DataFrame | None = None
    below: DataFrame | None = None
    levels = [r[0] for r in dirs.select("depth").distinct().orderBy(F.desc("depth")).collect()]  # as many as a path has parts
    for k, level in enumerate(levels):
        children = leaves.filter(F.col("depth") == level).select("parent", "checksum", "size")
        if below is not None:
            children = children.unionByName(below)
        summed = _streamed_level(children, algorithm) if streamed else _level(children, algorithm, context)
        own = dirs.filter(F.col("depth") == level).join(summed, "path", "left")
        own = own.select("path", "permissions", "parent", F.coalesce("checksum", empty).alias("checksum"), F.coalesce("size", F.lit(0)).alias("size"))
        # each level is read twice, here and above
        own = checkpoint(own) if k % CUT_EVERY == CUT_EVERY - 1 else own
        rolled = own if rolled is None else rolled.unionByName(own)
        below = own.filter(F.col("parent").isNotNull()).select("parent", "checksum", "size")
    rows = files.select(F.lit("F").alias("path_type"), "permissions", "checksum", "size", "path")
    if rolled is None:
        return rows
    return rows.unionByName(rolled.withColumn("path_type", F.lit("D")).select(*MANIFEST_COLUMNS))


def directory_sizes(files: DataFrame) -> DataFrame:
    """path and size of every directory in one pass: sums telescope, so each file adds to all its ancestors."""
    parts = F.split(F.regexp_replace("path", r"[^/]*$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    return files.select(F.explode(prefixes).alias("path"), "size").groupBy("path").agg(F.sum("size").alias("size"))


def manifest_text(manifest: DataFrame) -> Column:
    """Aggregate over a manifest: its lines in byte order of the paths, each ended."""
    lines = F.array_sort(F.collect_list(F.struct("path", format_line().alias("line"))))
    return F.concat(F.array_join(F.transform(lines, lambda x: x.line), "\n"), F.lit("\n"))


def snapshot_id(manifest: DataFrame, algorithm: str = "blake3") -> DataFrame:
    """One row (id): the digest of the manifest's text. Ids are never keyed."""
    text = manifest.agg(manifest_text(manifest).alias("text"))
    return text.select(digest(F.col("text"), algorithm).alias("id"))


def snapshot_id_streamed(manifest: DataFrame, algorithm: str = "blake3") -> str:
    """The same id of a manifest that is too long for a row: the driver streams the sorted lines partition by partition."""
    from ..functions.hashing import digest_stream

    rows = manifest.orderBy("path").select(format_line().alias("line")).toLocalIterator(prefetchPartitions=True)
    return digest_stream((f"{r.line}\n".encode() for r in rows), algorithm)


def snapshot_id_parallel(manifest: DataFrame) -> str:
    """The same BLAKE3 id, of any length: tasks hash the subtrees of the sorted text that lie in their own ranges.

    The driver gets the length of each range, and then a few tree nodes and less than two chunks of
    bytes from each.
    """
    lines = manifest.select("path", format_line().alias("line")).repartitionByRange("path").sortWithinPartitions("path").select("line")
    lines = checkpoint(lines)  # the ranges stay as they are from here on

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = sum(len(x.encode()) + 1 for frame in frames for x in frame["line"])
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "size": [size]})

    starts, total = {}, 0
    for row in sorted(lines.mapInPandas(measured, "part int, size long").collect()):
        starts[row.part], total = total, total + row["size"]

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        span = Span(starts[TaskContext.get().partitionId()], total)
        for frame in frames:
            span.update("".join(f"{x}\n" for x in frame["line"]).encode())
        span.finish()
        rows = [(level, index, value.astype("<u4").tobytes()) for (level, index), value in span.nodes.items()]
        rows += [(-1, at, data) for at, data in span.ends]
        if rows:
            yield pd.DataFrame(rows, columns=["level", "at", "data"])

    found = lines.mapInPandas(hashed, "level int, at long, data binary").collect()
    return combine_spans(((r.level, r["at"], bytes(r.data)) for r in found if r.level >= 0), ((r["at"], bytes(r.data)) for r in found if r.level < 0), total).hex()


def inventory_id(inventory: DataFrame, context: str = "", algorithm: str = "blake3") -> DataFrame:
    """One row (id) over a context and all (path, checksum) of an inventory, in order."""
    lines = F.array_sort(F.collect_list(F.concat_ws("  ", "checksum", "path")))
    text = inventory.agg(F.concat(F.lit(context), F.array_join(lines, "\n"), F.lit("\n")).alias("text"))
    return text.select(digest(F.col("text"), algorithm).alias("id"))
