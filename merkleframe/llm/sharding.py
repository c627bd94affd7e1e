"""Minimax contiguous partition of documents into shards, with groups of equal texts kept whole.

The groups are ordered by the MD5 of their text. The smallest feasible capacity is found by binary
search; a greedy pass checks each capacity: a shard takes groups in order while its bytes stay within
the capacity, and a group above the capacity takes a shard of its own. The shards are cut where the
greedy pass of the smallest feasible capacity cuts.

The search never needs the groups themselves. It works on a trie of digest prefixes, of which the
driver holds sums, maxima and counts only: 4,096 prefixes at first, and then finer ones just where a
cut may fall. A capacity is simulated twice, with every undivided prefix taken as freely divisible (no
partition can do better) and with the least fill that its largest group allows (no greedy pass does
worse). Where the two disagree, the prefixes between the two cuts are divided further, until the
answer and all cuts are exact. What the driver receives depends on the number of shards and on the
fan-out, not on the number of rows.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Hex digits of the first prefixes, and by how many they grow when divided.
FIRST_DIGITS, MORE_DIGITS, ALL_DIGITS = 3, 2, 32
#: Slots are numbered within so many cells a shard, so that no task sorts a whole shard.
CELLS = 4096


class _Node:
    __slots__ = ("prefix", "total", "largest", "groups")

    def __init__(self, prefix: str, total: int, largest: int, groups: int):
        self.prefix, self.total, self.largest, self.groups = prefix, total, largest, groups

    @property
    def whole(self) -> bool:
        return self.groups == 1 or len(self.prefix) >= ALL_DIGITS


class _Trie:
    def __init__(self, nodes: list[_Node]):
        self.nodes = sorted(nodes, key=lambda n: n.prefix)
        self.starts = [0, *accumulate(n.total for n in self.nodes)]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def cuts(self, capacity: int, hopeful: bool, most: int) -> list[int] | None:
        """Byte positions at which the shards end, or None if they are more than ``most``."""
        at, out = 0, []
        while at < self.total:
            if len(out) == most:
                return None
            target = at + capacity
            if target >= self.total:
                at = self.total
            else:
                k = bisect_right(self.starts, target) - 1
                node = self.nodes[k]
                if node.whole:
                    # a group above the capacity stands alone
                    at = self.starts[k] if self.starts[k] > at else self.starts[k + 1]
                else:
                    at = target if hopeful else max(self.starts[k], target - node.largest + 1)
            out.append(at)
        return out

    def smallest(self, low: int, high: int, hopeful: bool, shards: int) -> int:
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, hopeful, shards) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def between(self, low: int, high: int) -> list[_Node]:
        """Undivided nodes that hold a position from low to high."""
        k, out = max(0, bisect_right(self.starts, low) - 1), []
        while k < len(self.nodes) and self.starts[k] <= high:
            if not self.nodes[k].whole:
                out.append(self.nodes[k])
            k += 1
        return out


def _summed(groups: DataFrame, digits: int) -> list[_Node]:
    rows = (
        groups.groupBy(F.substring("group_key", 1, digits).alias("prefix"))
        .agg(F.sum("bytes").alias("total"), F.max("bytes").alias("largest"), F.count(F.lit(1)).alias("groups"))
        .collect()
    )
    return [_Node(r.prefix, r.total, r.largest, r.groups) for r in rows]


def _divided(trie: _Trie, groups: DataFrame, chosen: list[_Node]) -> _Trie:
    by_length: dict[int, set[str]] = {}
    for node in chosen:
        by_length.setdefault(len(node.prefix), set()).add(node.prefix)
    gone = set().union(*by_length.values())
    kept = [n for n in trie.nodes if n.prefix not in gone]
    for length, prefixes in by_length.items():
        # the range on the key itself can be pushed to a sorted table
        rows = groups.filter(F.col("group_key").between(min(prefixes), max(prefixes) + "g"))
        rows = rows.filter(F.substring("group_key", 1, length).isin(sorted(prefixes)))
        kept += _summed(rows, min(ALL_DIGITS, length + MORE_DIGITS))
    return _Trie(kept)


def boundaries(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest feasible capacity and the key prefixes at which shards 1, 2, ... begin.

    ``groups`` has group_key (hex digest) and bytes, one row a group. No groups: capacity 0, no cut.
    """
    trie = _Trie(_summed(groups, FIRST_DIGITS))
    if not trie.nodes:
        return 0, []
    ideal = -(-trie.total // shards)
    floor = max(1, ideal // 4)  # only groups that large can stand alone, and there are at most 4 x shards of them
    while large := [n for n in trie.nodes if not n.whole and n.largest >= floor]:
        trie = _divided(trie, groups, large)
    top = ideal + max(n.largest for n in trie.nodes)
    while True:
        low = trie.smallest(floor, top, True, shards)
        high = trie.smallest(low, top, False, shards)
        early, late = trie.cuts(low, False, 4 * shards) or [], trie.cuts(high, True, shards)
        unclear = {}
        for k, end in enumerate(late):
            for node in trie.between(early[k] if k < len(early) else 0, end):
                if end < trie.total or (k < len(early) and early[k] < trie.total):
                    unclear[node.prefix] = node
        if not unclear:
            break
        trie = _divided(trie, groups, list(unclear.values()))
    cuts = trie.cuts(high, False, shards)
    return high, [trie.nodes[trie.starts.index(c)].prefix for c in cuts[:-1]]


def group_key(text: Column) -> Column:
    """MD5 of the text; a null text has the key of a byte that no text holds alone."""
    return F.md5(F.coalesce(text.cast("binary"), F.unhex(F.lit("FF"))))


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null).

    size: UTF-8 bytes of the text plus 1; a null text has none and is a group apart from the empty
    text. Repeated rows are rows like any other; null ids are kept and count in their group. An empty
    table gives no rows. Other columns of the input are not looked at. A slot is the place within the
    shard, gapless from 0; documents are numbered cell by cell, and by id within a cell.
    """
    digest = checkpoint(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            group_key(F.col(text)).alias("group_key"),
        )
    )
    groups = checkpoint(digest.groupBy("group_key").agg(F.sum("size").alias("bytes")))
    _, starts = boundaries(groups, shards)
    shard = F.lit(0)
    for start in starts:
        shard = shard + (F.col("group_key") >= F.lit(start)).cast("int")
    placed = digest.withColumn("shard", shard.cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(CELLS)).cast("int"))
    # at most shards x CELLS rows, whatever the input: safe to broadcast
    before = placed.groupBy("shard", "cell").count().withColumn(
        "before", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "group_key"))
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(before.drop("count")), ["shard", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("within") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
