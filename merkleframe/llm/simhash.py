"""SimHash near-duplicates with multi-index hashing.

A fingerprint has 64 bits, and documents link at 2 or fewer differing bits. The fingerprints are
indexed by their two 32-bit segments. Two linked fingerprints differ by at most 1 bit in the first
segment, or by none in the second, so each fingerprint looks up the 33 keys of the Hamming ball of
radius 1 around its first segment and the single key of its second segment, and every candidate found
is verified on all 64 bits.

A segment value that very many different fingerprints share (a large family of near copies) would pair
them all. Such buckets are left out of the join and searched with both segments at once: every
fingerprint that can meet the bucket is filed under the 65 values of the ball of radius 1 around the
whole fingerprint. Two fingerprints differ by at most 2 bits just when they share such a value, so
linking each to the least one there keeps the same components with at most 65 links a fingerprint.
Equal fingerprints are searched once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint
from .components import connected_components

DISTANCE = 2
#: A segment value that more different fingerprints share is searched with both segments at once.
BUCKET_BOUND = 64
_CHUNK = 1 << 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # of each byte value
_OFFSETS = np.arange(8, dtype=np.int64) * 256


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes (little-endian) each bit is set."""
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048)
    return (seen.reshape(8, 256) @ _BITS).ravel()


def _majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of shingles that are hashed already; 0 of none."""
    hashes = np.ascontiguousarray(hashes, "<u8")
    return _majority(sum((_bit_counts(hashes[k : k + _CHUNK]) for k in range(0, len(hashes), _CHUNK)), np.zeros(64, np.int64)), len(hashes))


def fingerprint_text(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text: bit k is set if over half of the 3-word shingles' XXH64 have it set.

    Words are runs other than ASCII white space, with A-Z in lower case; fewer than three words make
    one shingle; null and wordless texts have fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _CHUNK):
        part = words[start : min(start + _CHUNK, n) + 2]
        shingles = zip(part, part[1:], part[2:]) if len(words) > 2 else [part]
        hashes = np.array([digest(b" ".join(s), 42) for s in shingles], dtype="<u8")
        counts += _bit_counts(hashes)
    return _majority(counts, n)


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_text(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long."""
    return _fingerprints(text)


def _ball(value: Column, bits: int) -> Column:
    """The value and all values at one differing bit, among the lowest ``bits``."""
    return F.explode(F.array(value, *(value.bitwiseXOR(F.lit(np.int64(np.uint64(1 << k)).item())) for k in range(bits))))


def _segments(fp: str) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))


def links(fingerprints: DataFrame, bucket_bound: int = BUCKET_BOUND) -> DataFrame:
    """Edges (u, v) that connect exactly the different fingerprints (column fp, distinct) at most 2 bits apart.

    Each pair found is a link; within buckets over ``bucket_bound``, links through a common neighbour
    stand for the pairs, so components are those of all links.
    """
    high, low = _segments("fp")
    index = fingerprints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("segment"), high.alias("key")), F.struct(F.lit(1).alias("segment"), low.alias("key")))).alias("at")).select("at.segment", "at.key", "fp")
    probes = fingerprints.select(F.lit(0).alias("segment"), _ball(high, 32).alias("key"), "fp").unionByName(fingerprints.select(F.lit(1).alias("segment"), low.alias("key"), "fp"))
    crowded = checkpoint(index.groupBy("segment", "key").count().filter(F.col("count") > bucket_bound).select("segment", "key"))
    some = not crowded.isEmpty()
    if some:
        crowd = probes.join(crowded, ["segment", "key"], "left_semi").select("fp").distinct()
        index = index.join(crowded, ["segment", "key"], "left_anti")
    differing = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    found = (
        probes.join(index.withColumnRenamed("fp", "other"), ["segment", "key"])
        .filter((F.col("fp") > F.col("other")) & (differing <= DISTANCE))
        .select(F.col("fp").alias("u"), F.col("other").alias("v"))
    )
    if some:
        filed = checkpoint(crowd.select(_ball(F.col("fp"), 64).alias("key"), "fp"))
        least = filed.groupBy("key").agg(F.min("fp").alias("other"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        met = filed.join(least, "key").filter((F.col("fp") > F.col("other")) & (differing <= DISTANCE))
        found = found.unionByName(met.select(F.col("fp").alias("u"), F.col("other").alias("v")))
    return found.distinct()


def _rooted(prints: DataFrame, bucket_bound: int) -> DataFrame:
    """(fp, root) of the different fingerprints in ``prints``, where root is a fingerprint of the same component."""
    prints = checkpoint(prints.select("fp").distinct())
    roots = connected_components(links(prints, bucket_bound))
    return prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bound: int = BUCKET_BOUND) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long) and component_id, the least id reachable over links.

    Null and wordless texts have fingerprint 0 and link like any other. A null id takes part, but is
    never a component's id unless the component has no other (then null). Repeated rows give repeated
    rows; an empty table gives none. Other columns are not looked at.
    """
    prints = checkpoint(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = checkpoint(_rooted(prints, bucket_bound).join(least, "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bound: int = BUCKET_BOUND) -> DataFrame:
    """The rows of ``docs``, with all columns, without near duplicates: one row of each component stays.

    It is the one with the least id (null ones last), of equal ids the one with the least hash of its
    text, and any one of rows that are alike in both.
    """
    key = row_keys(doc_id, text)
    prints = checkpoint(docs.select(key["d"].alias("d"), key["h"].alias("h"), fingerprint(F.col(text)).alias("fp")))
    firsts = prints.groupBy("fp").agg(F.min(F.struct("d", "h")).alias("first"))
    kept = _rooted(prints, bucket_bound).join(firsts, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.d", "first.h")
    return rows_of(docs, key, prints, kept)


def row_keys(doc_id: str, text: str) -> dict[str, Column]:
    """What rows are told apart by: the id (null ones last) and a hash of the text."""
    last = F.lit((1 << 63) - 1)
    return {"d": F.coalesce(F.col(doc_id).cast("long"), last), "h": F.coalesce(F.xxhash64(text), last)}


def rows_of(docs: DataFrame, key: dict[str, Column], prints: DataFrame, kept: DataFrame) -> DataFrame:
    """A row of ``docs`` for each key (d, h) of ``kept``; ``prints`` has the keys of all rows."""
    counted = checkpoint(prints.join(kept, ["d", "h"]).groupBy("d", "h").count())
    rows = docs.select(key["d"].alias("d"), key["h"].alias("h"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = rows.join(counted.filter("count = 1"), ["d", "h"], "left_semi").select("row.*")
    repeated = counted.filter("count > 1")
    if not repeated.isEmpty():
        alike = rows.join(repeated, ["d", "h"], "left_semi")
        out = out.unionByName(alike.groupBy("d", "h").agg(F.first("row").alias("row")).select("row.*"))
    return out


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
