"""Digests that are kept from one scan to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest


def fingerprint(*columns: str, context: str = ""):
    """A digest of what tells that a file changed (its path, inode, mode, size and time, say) and of the hashing context."""
    return F.sha2(F.concat_ws("\x00", F.lit(context), *(F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in columns)), 256)


def rehash(scan: DataFrame, known: DataFrame, content: str = "content", algorithm: str = "sha256", context: str | None = None) -> DataFrame:
    """The scan with checksum and reused: the checksum known for (fingerprint, path), or else of the content.

    Content is hashed for rows without a known checksum only, after the join.
    """
    kept = known.select("fingerprint", "path", F.col("checksum").alias("known")).dropDuplicates(["fingerprint", "path"])
    joined = scan.join(kept, ["fingerprint", "path"], "left")
    new = F.when(F.col("known").isNull(), F.col(content))  # null, and so not hashed, where the checksum is known
    return joined.withColumn("checksum", F.coalesce("known", digest(new, algorithm, context))).withColumn("reused", F.col("known").isNotNull()).drop("known", content)
