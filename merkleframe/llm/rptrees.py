"""Embedding near-duplicates with a forest of random-projection trees.

Each tree splits the vectors of a label by random projections, again and again. A split sends the
vectors around its middle (the spill) to both sides, so that near vectors are rarely parted, and a
tree's leaves hold a bounded number of them. Within a leaf all pairs are compared; what one tree parts,
others bring together. The spill is at least as wide as linked vectors lie apart on the projection, so
a split parts few of them however dense its node is.

- The thresholds of a split come from a bounded sample of the node's vectors; every vector is routed.
  A pass grows each node that is still too large by several levels, so the number of passes grows with
  the logarithm of the input.
- A pair that meets in several leaves is counted in the first of them only. Each vector carries the
  list of its leaves, so this needs no list of pairs: a leaf gives a row per vector, with the number of
  links and its place in the leaf's own components.
- Equal vectors of a label are one vector with a multiplicity.
- A node whose halves would have as many pairs as itself (a dense group, or vectors that no projection
  tells apart) isn't split, and is compared exactly, in pairs of blocks. Such a group stays together in
  all trees, so a large leaf leaves out the pairs of its members that are together in an earlier one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, unit_hash
from .components import connected_components

COSINE = 0.93
TREES = 10
#: Vectors in a leaf: nodes are split down to LEAF, and one of up to SPARE times that is left as it is.
LEAF, SPARE = 1536, 1.5
#: The middle share of a node that goes to both sides of its split.
SPILL = 0.2
#: The least width of the spill, in standard deviations of the projected difference of two vectors at the cosine.
WIDTH = 4 / 3
#: Directions and places that are tried before a node is left whole.
DIRECTIONS, PLACES = 6, (0.5, 0.3, 0.4, 0.6, 0.7)
#: A leaf of more times LEAF is compared in pairs of blocks.
WHOLE = 2
#: Vectors that a node's splits are fitted on, about, and the levels that a pass grows.
SAMPLE, LEVELS = 4096, 6
#: Fitted nodes that may be broadcast (each has up to 2^LEVELS - 1 splits, about 1.5 kB).
BROADCAST_NODES = 4096
_NODE = ["label", "dim", "tree", "node"]


def usable(vector: Column) -> Column:
    """Neither null nor zero nor empty, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=8192)
def _direction(tree: int, node: int, dim: int, turn: int = 0) -> np.ndarray:
    seed = int.from_bytes(hashlib.blake2b(f"{tree} {node} {dim}{f' {turn}' if turn else ''}".encode(), digest_size=8).digest(), "little")
    return np.random.default_rng(seed).standard_normal(dim)


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes: of 4-byte components where those are exact."""
    for frame in frames:
        out = []
        for v in frame["v"]:
            wide = np.asarray(v, "<f8")
            narrow = wide.astype("<f4")
            out.append((b"f" + narrow.tobytes()) if (narrow == wide).all() else (b"d" + wide.tobytes()))
        yield frame.assign(v=out)


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors in double precision, of packed ones."""
    x = np.empty((len(vectors), dim))
    values = vectors.to_numpy()
    wide = np.fromiter(map(len, values), np.int64, len(values)) > 4 * dim + 1
    for own, kind in ((~wide, "<f4"), (wide, "<f8")):
        if own.any():
            x[own] = np.frombuffer(b"".join(v[1:] for v in values[own]), kind).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best_split(x: np.ndarray, tree: int, node: int, spill: float, width: float) -> tuple[float, float, int] | None:
    """Thresholds and direction: the first even split that leaves fewer pairs, or else the one that leaves fewest; None if none does."""
    best, least = None, 1.0
    for turn in range(DIRECTIONS):
        p = np.sort(x @ _direction(tree, node, x.shape[1], turn))
        for place in PLACES:
            low, middle, high = np.quantile(p, [place - spill / 2, place, place + spill / 2])
            low, high = min(low, middle - width / 2), max(high, middle + width / 2)
            left, right = np.searchsorted(p, high, "right") / len(p), 1 - np.searchsorted(p, low) / len(p)
            if left < 1 and right < 1 and left**2 + right**2 < least:
                best, least = (low, high, turn), left**2 + right**2
                if place == 0.5:
                    return best
    return best


def fit_splits(x: np.ndarray, size: int, tree: int, node: int, leaf: int = LEAF, spill: float = SPILL, levels: int = LEVELS, cosine: float = COSINE) -> np.ndarray:
    """Thresholds (lower, upper) and direction of the splits below a node of ``size`` vectors, by heap position; NaN: no split."""
    out = np.full(((1 << levels) - 1, 3), np.nan)
    rate, width = len(x) / max(1, size), WIDTH * np.sqrt(max(0.0, 2 - 2 * cosine))
    todo = [(0, node, x)]
    while todo:
        k, path, own = todo.pop()
        if k >= len(out) or len(own) <= leaf * rate or len(own) < 32:
            continue
        found = _best_split(own, tree, path, spill, width)
        if found is None:
            continue
        out[k] = low, high, turn = found
        p = own @ _direction(tree, path, x.shape[1], turn)
        todo += [(2 * k + 1, 2 * path, own[p <= high]), (2 * k + 2, 2 * path + 1, own[p >= low])]
    return out


def route(x: np.ndarray, splits: np.ndarray, tree: int, node: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, rows that go there); with the spill a row may go to several."""
    todo = [(0, node, np.arange(len(x)))]
    while todo:
        k, path, own = todo.pop()
        if not len(own):
            continue
        if k >= len(splits) or np.isnan(splits[k, 0]):
            yield path, own
            continue
        p = x[own] @ _direction(tree, path, x.shape[1], int(splits[k, 2]))
        todo += [(2 * k + 1, 2 * path, own[p <= splits[k, 1]]), (2 * k + 2, 2 * path + 1, own[p >= splits[k, 0]])]


def _grown(rows: DataFrame, counts: DataFrame, leaf: int, types: str, cosine: float) -> DataFrame:
    """One pass: ``rows`` (node key, c, v) of the nodes in ``counts`` (node key, n), routed to new nodes (without v)."""

    def fitted(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        splits = fit_splits(_matrix(own["v"], int(key[1])), int(own["n"].iloc[0]), int(key[2]), int(key[3]), leaf, cosine=cosine)
        return pd.DataFrame([[*key, splits.astype("<f8").tobytes()]], columns=[*_NODE, "splits"])

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            places, nodes = [], []
            for key, at in frame.groupby(_NODE, sort=False).indices.items():
                splits = np.frombuffer(frame["splits"].iloc[at[0]], "<f8").reshape(-1, 3)
                x = _matrix(frame["v"].iloc[at], int(key[1]))
                for node, own in route(x, splits, int(key[2]), int(key[3])):
                    places.append(at[own])
                    nodes.append(np.full(len(own), node, np.int64))
            if places:
                yield frame.iloc[np.concatenate(places)].assign(node=np.concatenate(nodes))[[*_NODE, "c"]]

    few = counts.count() <= BROADCAST_NODES
    near = F.broadcast if few else (lambda x: x)
    sample = rows.join(near(counts), _NODE).filter(unit_hash(F.col("c"), F.col("tree")) < SAMPLE / F.col("n"))
    splits = checkpoint(sample.groupBy(*_NODE).applyInPandas(fitted, f"{types}, splits binary"))
    return rows.join(near(splits), _NODE).mapInPandas(routed, f"{types}, c long")


def forest(vectors: DataFrame, trees: int = TREES, leaf: int = LEAF, cosine: float = COSINE) -> DataFrame:
    """Rows (label, dim, tree, node, c): the leaves of each vector of ``vectors`` (label, dim, c, v)."""
    types = f"label {dict(vectors.dtypes)['label']}, dim int, tree int, node long"
    rows = vectors.select("label", "dim", F.explode(F.array(*(F.lit(t) for t in range(trees)))).alias("tree"), F.lit(1).cast("long").alias("node"), "c", "v")
    settled = None
    placed = rows.drop("v")
    stuck_at: DataFrame | None = None
    while True:
        counts = placed.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > int(leaf * SPARE))
        if stuck_at is not None:  # a node that kept its place can't be split
            counts = counts.join(stuck_at, _NODE, "left_anti")
        counts = checkpoint(counts)
        few = F.broadcast if counts.count() <= BROADCAST_NODES else (lambda x: x)
        if settled is None:  # a label that isn't split has the same leaf in all trees
            divided = few(counts.filter("tree = 0").select("label", "dim"))
            placed = placed.filter("tree = 0").unionByName(placed.filter("tree > 0").join(divided, ["label", "dim"], "left_semi"))
        if counts.isEmpty():
            return placed if settled is None else settled.unionByName(placed)
        small = few(counts)
        done = placed.join(small, _NODE, "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        placed = checkpoint(_grown(rows.join(small.drop("n"), _NODE, "left_semi"), counts, leaf, types, cosine))
        stuck_at = counts.select(*_NODE)
        rows = placed.join(vectors.select("c", "v"), "c")


def _components(linked: np.ndarray) -> np.ndarray:
    """The first member of each row's component."""
    n = len(linked)
    some = linked.any(0)
    root = np.where(some, -1, np.arange(n))
    for k in np.flatnonzero(some).tolist():
        if root[k] >= 0:
            continue
        inside = np.zeros(n, bool)
        front = np.zeros(n, bool)
        front[k] = True
        while front.any():
            inside |= front
            front = linked[front].any(0) & ~inside
        root[inside] = k
    return root


def _first_meeting(codes: np.ndarray, i: np.ndarray, j: np.ndarray, here: int) -> np.ndarray:
    """Whether the least leaf that rows i and j share is this one. codes: the leaves of each row, padded with -1."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 14):
        a, b = codes[i[k : k + (1 << 14)]], codes[j[k : k + (1 << 14)]]
        earlier = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0) & (a[:, :, None] < here)).any((1, 2))
        out[k : k + (1 << 14)] = ~earlier
    return out


def compare(own: pd.DataFrame, dim: int, here: int, across: bool, cosine: float) -> pd.DataFrame:
    """Links within a leaf, or between its two blocks: c, links (to vectors, in pairs first met here) and root."""
    own = own.sort_values("c", kind="stable").reset_index(drop=True)
    x, c = _matrix(own["v"], dim), own["c"].to_numpy()
    narrow = x.astype(np.float32)
    perhaps = narrow @ narrow.T >= cosine - 1e-4
    np.fill_diagonal(perhaps, False)
    some = np.flatnonzero(perhaps.any(0) | perhaps.any(1))  # all else is about those that may have a link
    near = x[some] @ x[some].T >= cosine
    np.fill_diagonal(near, False)
    own, c = own.iloc[some], c[some]
    near |= near.T
    if across:
        block = own["b"].to_numpy()
        near &= block[:, None] != block[None, :]
    links = np.zeros(len(own), np.int64)
    copies = own["copies"].to_numpy()
    leaves = [x[: np.searchsorted(x, here)] for x in (np.frombuffer(x, ">i8") for x in own["leaves"])]
    if not any(map(len, leaves)):  # nothing comes before this leaf
        for k in range(0, len(own), 1024):
            links[k : k + 1024] = near[k : k + 1024] @ copies
    else:
        i, j = np.nonzero(np.triu(near))
        codes = np.full((len(own), max(map(len, leaves))), -1, np.int64)
        for k, x in enumerate(leaves):
            codes[k, : len(x)] = x
        first = _first_meeting(codes, i, j, here)
        i, j = i[first], j[first]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
    root = _components(near) if near.any() else np.arange(len(own))
    keep = (links > 0) | (root != np.arange(len(own)))
    return pd.DataFrame({"c": c[keep], "links": links[keep], "root": c[root[keep]]})


def _in_blocks(dealt: DataFrame, ids: DataFrame, large: DataFrame, leaf: int) -> DataFrame:
    """``dealt`` with the block b and the pair of blocks (x, y) of each row: all 0 but in the ``large`` leaves.

    Members of a large leaf that share the earlier large leaf with most of its members have met there:
    their blocks are numbered from -1 down and meet only those of the others, from 1 up.
    """
    key = ["label", "dim", "leaf"]
    member = checkpoint(ids.join(F.broadcast(large), key).select(*key, "c"))
    before = member.select("c", F.col("leaf").alias("earlier"))
    shared = member.join(before, "c").filter("earlier < leaf").groupBy(*key, "earlier").count()
    main = checkpoint(shared.groupBy(*key).agg(F.max_by("earlier", F.struct("count", "earlier")).alias("earlier")))
    met = member.join(F.broadcast(main), key).join(before, ["c", "earlier"], "left_semi").select(*key, "c", F.lit(True).alias("met"))
    member = checkpoint(member.join(met, [*key, "c"], "left").withColumn("met", F.coalesce("met", F.lit(False))))
    placed = paired_blocks(member, key, leaf)
    small = dealt.join(F.broadcast(large), key, "left_anti").withColumns({"b": F.lit(0), "x": F.lit(0), "y": F.lit(0)})
    return small.unionByName(dealt.join(placed, [*key, "c"]))


def paired_blocks(member: DataFrame, key: list[str], leaf: int) -> DataFrame:
    """``member`` (key, c, met), in each pair (x, y) of blocks of about ``leaf`` that its block b takes part in: all pairs but those of two that have met."""
    count = lambda own: F.ceil(F.count(F.when(own, 1)) / leaf).cast("int")
    blocks = checkpoint(member.groupBy(*key).agg(count(~F.col("met")).alias("new"), count(F.col("met")).alias("old")))
    place = F.pmod(F.xxhash64("c"), F.when(F.col("met"), F.col("old")).otherwise(F.col("new"))).cast("int") + 1
    placed = member.join(blocks, key).withColumn("b", F.when(F.col("met"), -place).otherwise(place))
    # a new block meets all blocks and itself, an old one the new ones; a block 0 doesn't exist
    up = F.when(F.col("new") > 0, F.sequence(F.lit(1), F.col("new"))).otherwise(F.array().cast("array<int>"))
    down = F.when(F.col("old") > 0, F.sequence(-F.col("old"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    pairs = F.explode(F.when(F.col("met"), up).otherwise(F.concat(up, down)))
    return placed.withColumn("o", pairs).select(*key, "c", "b", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))


def near_duplicates(rows: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row: vec_id, n_links (other vectors linked directly), component_id and kept.

    Vectors link at a cosine of at least ``cosine`` in double precision, if their labels are equal and
    not null and they have equally many components. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and neither do rows with a null id: they are their own
    component. Rows are vectors of their own, whatever their ids: repeated rows link with each other, and
    rows of one id need not. An empty table gives no rows.
    """
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    fit = F.coalesce(usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # equal vectors of a label: 128 bits of their hash
    marked = rows.select("vec_id", "label", "v", fit.alias("fit"), F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit(1), "v", "label").alias("k2"))
    members = checkpoint(marked.select("vec_id", "fit", "k1", "k2"))
    classes = marked.filter("fit").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = classes.withColumn("dim", F.size("v")).withColumn("v", F.col("v").cast("array<double>"))
    kinds = ", ".join(f"{n} {'binary' if n == 'v' else k}" for n, k in classes.dtypes)
    # ids may repeat, so a class has a number of its own, which the checkpoint keeps as it is
    classes = checkpoint(classes.mapInPandas(_packed, kinds).withColumn("c", F.monotonically_increasing_id()))
    vectors = classes.select("label", "dim", "c", "v")
    leaves = checkpoint(forest(vectors, trees, leaf, cosine))
    ids = leaves.withColumn("leaf", F.col("tree").cast("long") * (1 << 57) + F.col("node"))
    sizes = ids.groupBy("label", "dim", "leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WHOLE * leaf)
    split = checkpoint(sizes.select("label", "dim", "leaf"))
    # the list as bytes too, big end first: most vectors have no link, and then nobody looks at it
    packed = F.unhex(F.array_join(F.transform("all", lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    listed = checkpoint(ids.groupBy("c").agg(F.array_sort(F.collect_list("leaf")).alias("all")).withColumn("leaves", packed))
    dealt = classes.join(listed, "c").select("label", "dim", "c", "v", "copies", "leaves", F.posexplode("all").alias("at", "leaf"))
    dealt = dealt.withColumn("leaves", F.expr("substring(leaves, 1, 8 * at)")).drop("at")  # those before this one
    if split.isEmpty():
        dealt = dealt.withColumns({"b": F.lit(0), "x": F.lit(0), "y": F.lit(0)})
    else:
        dealt = _in_blocks(dealt, ids, split, leaf)

    def compared(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return compare(own, int(key[1]), int(key[2]), key[3] != key[4], cosine)

    found = checkpoint(dealt.groupBy("label", "dim", "leaf", "x", "y").applyInPandas(compared, "c long, links long, root long"))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("c <> root").select(F.col("c").alias("u"), F.col("root").alias("v")))
    rooted = checkpoint(roots.withColumnRenamed("node", "c").join(classes.select("c", "least"), "c"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.join(least, "root").select("c", "component_id")
    named = classes.select("k1", "k2", "c", "least", "copies").join(links, "c", "left").join(rooted, "c", "left")
    named = named.select("k1", "k2", F.lit(True).alias("fit"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = members.join(named, ["k1", "k2", "fit"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
