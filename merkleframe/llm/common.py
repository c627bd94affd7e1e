"""What the operators share: table reading, lineage cutting, hold-out folds and bounded samples."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session that names none gets a temporary folder; anywhere else that would be a
    machine-local one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint, which survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def parts_for(rows: int) -> int:
    """The most files that a checkpoint of so many narrow rows is worth: where Hadoop's native library is missing, each file costs two processes."""
    return max(16, rows // 50_000)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def unit_hash(*cols: Column, seed: str = "sample") -> Column:
    """A value in [0, 1) that depends on the columns only, so that a repeated task draws the same sample."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(df: DataFrame, by: str, bound: int, *ids: str) -> DataFrame:
    """About ``bound`` rows of each value of ``by`` (all rows where there are fewer), chosen by a hash of ``ids``.

    The counts of the values decide the rates, so no row moves; rows with a null ``by`` are left out.
    """
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect() if r[0] is not None}
    if not counts:
        return df.limit(0)
    keep = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        keep = keep | ((F.col(by) == F.lit(value)) & (unit_hash(*(F.col(c) for c in ids)) < min(1.0, bound / n)))
    return df.filter(keep)
