"""Approximate nearest neighbours: inverted lists scanned dimension by dimension, with early abandonment.

Every vector belongs to the lists of its two nearest centroids. A query probes the lists nearest to it:
as many as it takes for a measured recall. A few of the queries are compared with all rows, in blocks, and
the places that the lists of their true neighbours have in the queries' own orders tell how far down one
must go. Vectors and query are rotated at random, so that any few coordinates are a sample of all, and the
coordinates of a list lie in blocks of columns. After each block a candidate is abandoned if the
hypothesis that it is near enough fails: its partial distance, scaled to all dimensions, exceeds the
threshold by more than the sample's error allows. What survives is measured exactly on the original
vectors.

The threshold of a query is its k-th distance within its first lists, which are scanned before the
others. Lists are dealt in blocks of candidates and of queries, so that neither a crowded list nor a
common vector fills a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, unit_hash
from .rptrees import usable

K = 10
#: Vectors of a sample that the centroids are fitted on, about, and the greatest number of lists; below it there are LISTS_BY times the square root of the vectors.
SAMPLE, LISTS, LISTS_BY = 32_768, 1024, 2
#: Lists that a vector belongs to, and those that are scanned first, for the threshold.
SPREAD, FIRST = 2, 2
#: Queries that the probes are measured on, and the share of their neighbours that the probed lists must hold.
MEASURED, RECALL = 64, 0.95
#: Coordinates in a block, and the errors (in standard deviations) that a candidate is given.
COLUMNS, EPSILON = 16, 3.0
#: Rounding that a distance of rotated vectors is given, as a share of the greatest norm that a hit can have.
ROUNDING = 1e-9
#: Candidates and queries in a task's block, about.
CANDIDATES, QUERIES = 4096, 256
_SEED = 7


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means, from evenly spaced rows; a list that loses all keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=lists)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n centroids nearest to each row, nearest first."""
    out = np.empty((len(x), n), np.int64)
    for k in range(0, len(x), 4096):
        d = (c**2).sum(1)[None] - 2 * (x[k : k + 4096] @ c.T)
        if n == 1:
            out[k : k + 4096, 0] = np.argmin(d, 1)
        elif n == len(c):
            out[k : k + 4096] = np.argsort(d, axis=1, kind="stable")
        else:
            some = np.argpartition(d, n, axis=1)[:, :n]
            out[k : k + 4096] = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
    return out


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dim, dim)))[0]


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, bound: float, turned: np.ndarray, turned_q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k candidates nearest to q within ``bound``; turned: the rotated candidates, a column block after the other."""
    dim, alive = x.shape[1], np.flatnonzero(ids != own)
    if np.isinf(bound) and len(alive) > k:
        # no threshold yet: the k-th distance to the first candidates
        head = alive[: 4 * k]
        bound = float(np.partition(np.sqrt(((x[head] - q) ** 2).sum(1)), k - 1)[k - 1])
    # candidates and queries are rotated by separate products, so even a copy's partial distance is not quite 0
    slack = ROUNDING * (float(np.sqrt((q**2).sum())) + bound)
    partial = np.zeros(len(alive))
    for a in range(0, dim, COLUMNS):
        b = min(dim, a + COLUMNS)
        partial += ((turned[alive, a:b] - turned_q[a:b]) ** 2).sum(1)
        limit = bound * (1 + (EPSILON / np.sqrt(b) if b < dim else 0)) + slack
        near = partial * (dim / b) <= limit**2
        alive, partial = alive[near], partial[near]
    exact = np.sqrt(((x[alive] - q) ** 2).sum(1))
    best = np.lexsort((ids[alive], exact))[:k]
    return ids[alive][best], exact[best]


def _scanned(vectors: DataFrame, probes: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Hits (query_id, vec_id, score) of ``probes`` (query_id, q, bound, list) among ``vectors`` (vec_id, v, list)."""
    asked = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("query_blocks"))
    # a row for each list: at most LISTS
    sizes = F.broadcast(blocks.join(asked, "list"))
    numbered = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None).cast("double")
    candidates = vectors.join(sizes, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("cb"), numbered("query_blocks").alias("qb"), F.col("vec_id").alias("id"), "v", none.alias("bound"), F.lit(False).alias("asks"))
    queries = probes.join(sizes, "list").select("list", numbered("blocks").alias("cb"), F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("qb"), F.col("query_id").alias("id"), F.col("q").alias("v"), "bound", F.lit(True).alias("asks"))

    def searched(own: pd.DataFrame) -> pd.DataFrame:
        asks = own["asks"].to_numpy(bool)
        out = []
        if asks.any() and not asks.all():
            mine = own[~asks].sort_values("id", kind="stable")
            x, ids = _matrix(mine["v"]), mine["id"].to_numpy()
            turn = rotation(x.shape[1])
            turned, q = np.asfortranarray(x @ turn), _matrix(own[asks]["v"])
            for name, bound, a, b in zip(own[asks]["id"].tolist(), own[asks]["bound"].tolist(), q, q @ turn):
                found, score = scan(x, ids, a, name, bound, turned, b, k)
                out.append(pd.DataFrame({"query_id": name, "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, int), "vec_id": np.zeros(0, int), "score": np.zeros(0)})

    return candidates.unionByName(queries).groupBy("list", "cb", "qb").applyInPandas(searched, "query_id long, vec_id long, score double")


def probes_for(vectors: DataFrame, asked: DataFrame, middle: np.ndarray, k: int, recall: float = RECALL) -> int:
    """How many lists a query must probe for its lists to hold a share ``recall`` of the true neighbours of some queries, found among all ``vectors`` (vec_id, v, lists)."""
    some = asked.orderBy(unit_hash(F.col("query_id"), seed="measured"), "query_id").limit(MEASURED).collect()
    names, q = np.array([r.query_id for r in some]), np.array([r.q for r in some])
    place = np.argsort(nearest(q, middle, len(middle)), axis=1)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x, ids, lists = _matrix(frame["v"]), frame["vec_id"].to_numpy(), np.stack(frame["lists"].tolist())
                d = ((x**2).sum(1)[:, None] - 2 * (x @ q.T)) + (q**2).sum(1)
                d[ids[:, None] == names] = np.inf
                top = np.argpartition(d, min(k, len(d)) - 1, axis=0)[:k]
                asks = np.broadcast_to(np.arange(len(q)), top.shape)
                out = pd.DataFrame({"asks": asks.ravel(), "id": ids[top].ravel(), "d": d[top, asks].ravel(), "place": place[asks[:, :, None], lists[top]].min(2).ravel()})
                yield out[np.isfinite(out["d"])]

    found = vectors.mapInPandas(near, "asks int, id long, d double, place int")
    order = Window.partitionBy("asks").orderBy("d", "id")
    places = sorted(r.place for r in found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("place").collect())
    return places[int(np.ceil(recall * len(places))) - 1] + 1 if places else 1


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int = K, lists: int | None = None, recall: float = RECALL, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows to each query: query_id, rank (from 1), vec_id and score (Euclidean distance, in double precision).

    ``queries`` has the same columns; rows of the query's own id are no candidates for it, and a
    repeated query is asked once (with its least vector). Repeated rows count once. Ties go to the
    smaller id. Vectors that are null, empty, zero or hold null or non-finite components, null ids, and
    vectors with another number of components than most (of equals, the greatest) take no part. A query
    without candidates has no row; neither has an empty table.
    """
    chosen = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    vectors = chosen(rows)
    sizes = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes
    vectors = vectors.filter(F.size("v") == dim)
    asked = chosen(queries).filter(F.size("v") == dim).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    lists = lists or (min(LISTS, int(LISTS_BY * n**0.5)) if n > CANDIDATES else 1)  # what a block holds is scanned as one
    sample = vectors.filter(unit_hash(F.col("vec_id"), F.col("v")) < SAMPLE / n).orderBy("vec_id").collect() if lists > 1 else []
    lists = max(1, min(lists, len(sample)))
    middle = centroids(np.array([r.v for r in sample]), lists) if lists > 1 else np.zeros((1, dim))
    spread = min(SPREAD, lists)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(lists=list(nearest(_matrix(frame["v"]), middle, spread).astype(np.int32)))

    vectors = checkpoint(vectors.mapInPandas(placed, "vec_id long, v array<double>, lists array<int>"))
    asked = checkpoint(asked)
    probed = probes_for(vectors, asked, middle, k, recall)
    vectors = vectors.select("vec_id", "v", F.explode("lists").alias("list"))
    counts = checkpoint(vectors.groupBy("list").count())
    held = np.zeros(lists, np.int64)
    for r in counts.collect():  # at most LISTS rows
        held[r["list"]] = r["count"]

    def probing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k0 in range(0, len(frame), 256):
                own = frame.iloc[k0 : k0 + 256]
                order = nearest(_matrix(own["q"]), middle, lists)
                enough = (np.cumsum(held[order], axis=1) < 10 * spread * (k + 1)).sum(1) + 1
                size = np.minimum(np.maximum(probed, enough), lists)
                row = np.repeat(np.arange(len(own)), size)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                yield pd.DataFrame({"query_id": own["query_id"].to_numpy()[row], "q": own["q"].to_numpy()[row], "list": order[row, at].astype(np.int32), "place": at.astype(np.int32)})

    probes = checkpoint(asked.mapInPandas(probing, "query_id long, q array<double>, list int, place int"))
    blocks = counts.select("list", F.ceil(F.col("count") / CANDIDATES).cast("int").alias("blocks"))
    first = checkpoint(_ranked(_scanned(vectors, probes.filter(F.col("place") < FIRST).withColumn("bound", F.lit(float("inf"))), blocks, k), k))
    bounds = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    rest = probes.filter(F.col("place") >= FIRST).join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    hits = _scanned(vectors, rest, blocks, k).unionByName(first.select("query_id", "vec_id", "score"))
    return _ranked(hits, k).select("query_id", "rank", "vec_id", "score")
