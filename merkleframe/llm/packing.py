"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of at most the greatest length (nothing is dropped), the pieces are dealt
into groups of bounded size by a hash of their document, and each group is packed on its own, longest
pieces first. A piece goes into the open sequence whose room it fills best. Where none has room, a new
sequence is opened in the length of least cost per token, taking the tokens it will hold to be the
piece and, of the room left, the part that pieces still to come can fill. At last every sequence is
downsized to the shortest permitted length that holds its contents. Where opening the greatest length
only, and then downsizing, comes out cheaper for a group, it is packed so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Fixed cost of a sequence, in tokens.
OVERHEAD = 32
#: Pieces that are packed together, about.
GROUP_PIECES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


class _Rooms:
    """Open sequences by their room; finds the least room that is enough, in steps over 64-bit masks."""

    def __init__(self, most: int):
        self.by_room: list[list[int]] = [[] for _ in range(most + 1)]
        self.mask = 0  # bit r: a sequence with room r is open

    def add(self, room: int, sequence: int) -> None:
        if room:
            self.by_room[room].append(sequence)
            self.mask |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        above = self.mask >> need
        if not above:
            return None
        room = need + (above & -above).bit_length() - 1
        sequence = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        return room, sequence


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece and the final length of each sequence: the cheaper way of opening any length and of opening the greatest only.

    Sizes are at most the greatest length and in falling order; ties keep their order. Pieces of no
    tokens go to sequence 0 at offset 0 (a sequence of the least length if there is no other).
    """
    lengths = tuple(sorted(lengths))
    ways = [best_fit(sizes, opened, lengths, overhead) for opened in (lengths, lengths[-1:])]
    return min(ways, key=lambda way: way[2].sum() + overhead * len(way[2]))


def best_fit(sizes: np.ndarray, opened: tuple[int, ...], lengths: tuple[int, ...], overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``pack``, opening sequences of the lengths ``opened``, and downsizing them to ``lengths``."""
    n = len(sizes)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.append(np.cumsum(sizes[::-1])[::-1], 0)  # tokens from each piece on
    rooms, capacity, used = _Rooms(lengths[-1]), [], []
    for k, size in enumerate(sizes.tolist()):
        if not size:
            break
        found = rooms.take(size)
        if found is None:
            # pieces to come are no longer than this one, so they leave at most a part of the room unused
            rest, pieces = int(left[k + 1]), n - k - 1
            mean = rest / pieces if pieces else 0
            best = None
            for length in opened:
                if length >= size:
                    room = length - size
                    filled = min(rest, max(0.0, room - mean / 2)) if mean else 0.0
                    cost = (length + overhead) / (size + filled)
                    if best is None or cost < best[0]:
                        best = cost, length
            length = best[1]
            sequence[k] = len(capacity)
            rooms.add(length - size, len(capacity))
            capacity.append(length)
            used.append(size)
        else:
            room, own = found
            sequence[k], offset[k] = own, used[own]
            used[own] += size
            rooms.add(room - size, own)
    if n and not capacity:
        used.append(0)
    final = np.array(lengths)[np.searchsorted(np.array(lengths), np.array(used, np.int64))]
    return sequence, offset, final


def tokens(text: Column) -> Column:
    """Tokens of a text for packing: its words and an end mark; a null or wordless text has none."""
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return F.when(words > 0, words + 1).otherwise(F.lit(0).cast("long"))


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, group_pieces: int = GROUP_PIECES, doc_id: str = "doc_id", text: str = "text", size: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), n_tokens, group, sequence (within the group), offset, sequence_length.

    size: the documents' tokens, by default of ``tokens(text)``. A document longer than the greatest
    length has several pieces, all but the last of that length. A document without tokens has one
    empty piece. Null ids and repeated rows are packed like any other; an empty table gives no rows.
    Other columns are not looked at.
    """
    longest = max(lengths)
    sized = docs.select(F.col(doc_id).alias("doc_id"), (tokens(F.col(text)) if size is None else size).alias("size"), F.xxhash64(doc_id, text).alias("h"))
    sized = checkpoint(sized.select("doc_id", "size", "h", F.greatest(F.lit(1), F.ceil(F.col("size") / longest)).cast("int").alias("pieces")))
    total = sized.agg(F.sum("pieces")).first()[0] or 0
    groups = max(1, -(-total // group_pieces))
    pieces = sized.select("doc_id", "size", "h", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    pieces = pieces.select(
        "doc_id", "piece", "h",
        F.least(F.lit(longest), F.col("size") - F.col("piece") * longest).cast("long").alias("n_tokens"),
        # a very long document's pieces, and equal documents, are spread over the groups
        F.pmod(F.xxhash64("h", "piece", "doc_id"), F.lit(groups)).alias("group"),
    )

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in _by_group(frames):
            sequence, offset, final = pack(own["n_tokens"].to_numpy(), lengths, overhead)
            yield own.assign(sequence=sequence, offset=offset, sequence_length=final[sequence])[["doc_id", "piece", "n_tokens", "group", "sequence", "offset", "sequence_length"]]

    kind = dict(sized.dtypes)["doc_id"]
    ordered = pieces.repartition("group").sortWithinPartitions("group", F.desc("n_tokens"), "doc_id", "piece", "h")
    return ordered.drop("h").mapInPandas(packed, f"doc_id {kind}, piece int, n_tokens long, group long, sequence long, offset long, sequence_length long")


def _by_group(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups from frames that are sorted by group."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        ids = frame["group"].to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[-1]["group"].iloc[-1] != ids[a]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(frame.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True)
