"""Token ids of documents in files of Simple-8b blocks.

File format: a folder of Parquet files, each in ascending doc_id order and all in the order of their
``part``. A row is a block of whole documents:

- part, block: the place of the block; start: ids before the block within its part; n_ids: its ids;
- doc_ids, counts: the block's documents and how many ids each has, in order (their ids follow each
  other without a gap, across word limits);
- words: little-endian 64-bit Simple-8b words, stored as bytes;
- marks: for every MARK-th id, the index of the word that holds it and its place in that word, so that
  a reader can start anywhere without decoding from the block's beginning.

A word holds a selector in its top 4 bits and values in the other 60: as many as the selector's count,
each of its width, the first value lowest. Selector 0 is the escape for a value of over 60 bits: the
whole next word is that value. The last word may be padded with zeros; n_ids tells where to stop.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, checkpoint_folder

#: (count, width) of selectors 1 to 14. Selector 0 is the escape.
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
MARK = 1024
#: A block is closed once it holds so many ids; a longer document makes a longer block.
BLOCK_IDS = 1 << 16
#: Tokens whose ids are remembered within a worker, about 70 bytes each.
MEMO = 1_000_000

#: Files whose starts (16 bytes each) may be broadcast.
BROADCAST_PARTS = 1 << 17

_WIDTHS = np.array([w for _, w in PACKINGS])
_ESCAPE = len(PACKINGS)  # width class of values over 60 bits


def simple8b_encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of unsigned values and, for each packing, the index of its first value and of its (first) word."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = int(v.max())
    small = v.astype(np.int64) if top < 1 << 62 else None
    if top < 1 << 20:
        need = _class_table()[small]
    else:
        need = np.zeros(n, np.uint8)
        for w in _WIDTHS:
            need += v >= np.uint64(1 << int(w))
    # fits[i]: the largest count that can start at i; padding after the end fits anything
    fits = np.zeros(n + 60, np.uint8)
    span, window = 1, np.concatenate([need, np.zeros(60, np.uint8)])
    for count, k in sorted((c, k) for k, (c, _) in enumerate(PACKINGS)):
        while span < count:
            step = min(span, count - span)  # windows of `span` overlap to make one of span + step
            later = window[step:]
            window = np.maximum(window[: len(later)], later)
            span += step
        fit = fits[: len(window)]
        np.maximum(fit, (window <= k).view(np.uint8) * np.uint8(count), out=fit)
    steps, at, first = np.maximum(fits[:n], 1).tobytes(), 0, []
    put = first.append
    while at < n:
        put(at)
        at += steps[at]
    first = np.array(first, np.int64)
    count = fits[first]
    size = np.where(count == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    padded = np.concatenate([v, np.zeros(60, np.uint64)])
    for k, (c, w) in enumerate(PACKINGS):
        own = np.flatnonzero(count == c)
        if len(own):
            at, packed = first[own], np.full(len(own), (k + 1) << 60, np.uint64)
            for lane in range(c):
                packed |= padded[at + lane] << np.uint64(lane * w)
            words[place[own]] = packed
    raw = np.flatnonzero(count == 0)
    words[place[raw] + 1] = v[first[raw]]
    return words, first, place


_CLASSES: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(np.searchsorted((1 << _WIDTHS.astype(np.int64)) - 1, np.arange(1 << 20), side="left").astype(np.uint8))
    return _CLASSES[0]


def simple8b_decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of the words."""
    w = np.ascontiguousarray(words, dtype=np.uint64)
    selector = (w >> np.uint64(60)).astype(np.int64)
    if len(w) and (selector == 0).any():
        # a raw word follows each escape; a raw word may look like anything, so walk the escapes in order
        raw = np.zeros(len(w), bool)
        for k in np.flatnonzero(selector == 0).tolist():
            if not raw[k]:
                raw[k + 1] = True
        heads = np.flatnonzero(~raw)
    else:
        heads = np.arange(len(w))
    picked = selector[heads]
    counts = np.array([1, *(c for c, _ in PACKINGS), 0])[picked]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k, (c, width) in enumerate(PACKINGS):
        own = np.flatnonzero(picked == k + 1)
        if len(own):
            to, packed, mask = at[own], w[heads[own]], np.uint64((1 << width) - 1)
            for lane in range(c):
                out[to + lane] = (packed >> np.uint64(lane * width)) & mask
    own = np.flatnonzero(picked == 0)
    out[at[own]] = w[heads[own] + 1] if len(own) else 0
    return out[:n]


#: Bytes of the longest token that is remembered, and the texts that are cut into tokens together, about, in bytes.
_KEPT_BYTES, _CHUNK = 24, 1 << 20
#: What a byte of a token can be: a letter (or a part of one), a digit, a mark, a line end or a space; 0 leaves the cutting to the library.
_LETTER, _DIGIT, _MARK, _LINE, _BLANK = 1, 2, 3, 4, 5


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[0x21:0x7F] = _MARK
    out[ord("'")] = 0  # may begin a token of its own, as in don't
    for a, z in (("A", "Z"), ("a", "z")):
        out[ord(a) : ord(z) + 1] = _LETTER
    out[0x80:0xC0] = out[0xC3:0xCA] = _LETTER  # U+00C0 to U+024F, but for two signs, see _cut
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[ord("\n")], out[ord(" ")] = _LINE, _BLANK
    return out


_KINDS = _kinds()
#: A space that follows no white space, where a long text can be cut.
_CUT = re.compile(rb"[!-~] ")
_SPACES = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_KEY_MASKS = np.array([[(1 << 8 * min(8, max(0, n - 8 * k))) - 1 for k in range(3)] for n in range(_KEPT_BYTES + 1)], np.uint64)


def _cut(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the tokens of texts begin, how long they are, and whether one is left to the library's own cutting.

    data: the UTF-8 bytes of the texts, one after the other; starts: where the texts begin that aren't
    empty. A stretch goes from a space that follows no white space to the next such space, and the
    pre-tokenizer never joins what stands in different stretches. One of Latin letters, digits, marks
    and single line ends is cut where their kind changes, as the pre-tokenizer does; any other is left.
    """
    kind = _KINDS[data]
    sign = np.flatnonzero(data == 0xC3)
    sign = sign[sign + 1 < len(data)]
    kind[sign[(data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)]] = 0
    first = np.zeros(len(data), bool)
    blank = np.flatnonzero(data == 32)
    before = data[blank - 1]
    follows = _SPACES[before]
    wide = np.flatnonzero(before >= 0x80)  # perhaps the end of white space of two or three bytes
    at = blank[wide]
    follows[wide] = (data[at - 2] == 0xC2) | ((data[at - 3] >= 0xE1) & (data[at - 3] <= 0xE3))
    first[blank[~follows]] = True
    first[starts] = True
    stretches = np.flatnonzero(first)
    space = _SPACES[data]
    left = kind == 0
    left[1:] |= space[1:] & space[:-1] & ~first[1:]
    own = np.zeros(len(stretches), bool)
    stretch = np.cumsum(first, dtype=np.int32) - 1
    own[stretch[left]] = True
    begins = np.ones(len(data), bool)
    begins[1:] = kind[1:] != kind[:-1]
    after = blank + 1
    begins[after[after < len(data)]] = False  # a space belongs to what follows
    begins |= first
    at = np.flatnonzero(begins)
    left = own[stretch[at]]
    keep = ~left | first[at]
    at = at[keep]
    return at, np.diff(at, append=len(data)), left[keep]


class _Table:
    """Remembered tokens: an open-addressing hash table of their bytes, and their ids one after the other."""

    def __init__(self, most: int):
        self.most = most
        self.mask = np.uint64((1 << (2 * most - 1).bit_length()) - 1)
        self.clear()

    def clear(self) -> None:
        self.n = self.n_ids = 0
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        self.keys, self.kinds = np.zeros((1024, 3), np.uint64), np.zeros(1024, np.uint8)
        self.starts, self.counts, self.hit = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool)
        self.ids = np.zeros(4096, np.uint32)

    @staticmethod
    def hashed(keys: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        h = keys[:, 0] ^ kinds
        for k in (1, 2):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + keys[:, k]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def find(self, keys: np.ndarray, kinds: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        slot = h & self.mask
        todo = np.arange(len(h))
        while len(todo):
            entry = self.slots[slot]
            there = entry >= 0
            todo, entry, slot = todo[there], entry[there], slot[there]
            same = (self.keys[entry] == keys[todo]).all(1) & (self.kinds[entry] == kinds[todo])
            out[todo[same]] = entry[same]
            todo, slot = todo[~same], (slot[~same] + np.uint64(1)) & self.mask
        self.hit[out[out >= 0]] = True
        return out

    def _room(self, name: str, n: int) -> None:
        old = getattr(self, name)
        if n > len(old):
            new = np.zeros((max(n, 2 * len(old)), *old.shape[1:]), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def append(self, keys: np.ndarray, kinds: np.ndarray, ids: list[np.ndarray | list[int]]) -> np.ndarray:
        """New entries, which find() doesn't give yet."""
        a, b = self.n, self.n + len(ids)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(counts.sum())
        for name in ("keys", "kinds", "starts", "counts", "hit"):
            self._room(name, b)
        self._room("ids", self.n_ids + total)
        self.keys[a:b], self.kinds[a:b], self.counts[a:b], self.hit[a:b] = keys, kinds, counts, False
        self.starts[a:b] = self.n_ids + np.cumsum(counts) - counts
        self.ids[self.n_ids : self.n_ids + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.n, self.n_ids = b, self.n_ids + total
        return np.arange(a, b, dtype=np.int32)

    def file(self, entries: np.ndarray, h: np.ndarray) -> None:
        """Let find() give these entries, whose keys it doesn't have."""
        slot = h & self.mask
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            lost = self.slots[slot] != entries  # taken, or several wanted the same one
            entries, slot = entries[lost], (slot[lost] + np.uint64(1)) & self.mask

    def drop(self, n: int, n_ids: int) -> None:
        """Take back entries from the ``n``-th on, which were not filed."""
        self.n, self.n_ids = n, n_ids

    def renew(self) -> None:
        """Forget all entries but those that were asked for again; all if those are most."""
        kept = np.flatnonzero(self.hit[: self.n])
        if len(kept) > self.most // 2:
            kept = kept[:0]
        keys, kinds, ids = self.keys[kept], self.kinds[kept], [self.ids[s : s + c] for s, c in zip(self.starts[kept].tolist(), self.counts[kept].tolist())]
        self.clear()
        self.file(self.append(keys, kinds, ids), self.hashed(keys, kinds))


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, which sees each different token once.

    Texts are cut into tokens by array operations over their bytes (see ``_cut``), and the tokens' ids
    are looked up in a table. New ones go straight to the library's model, or, where the cutting is left
    to it, through the whole library. So do texts that hold a special token, as a whole.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        special = [re.escape(t.content.encode()) for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(special) or rb"\Z.")
        self.model = self.library.model
        self.model._resize_cache(0)  # each token comes once
        # the visible character that stands for each byte in the vocabulary
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {b: next(c for c, _ in shown.pre_tokenize_str(chr(b))) for b in range(128)}
        continued = {b: shown.pre_tokenize_str(bytes([0xC2 + (b >> 6 & 1), 0x80 | b & 0x3F]).decode())[0][0] for b in range(128)}
        self.shown |= {0x80 | b & 0x3F: continued[b][1] for b in range(64)}
        self.shown |= {b: shown.pre_tokenize_str(bytes([b, 0x80]).decode())[0][0][0] for b in range(0xC2, 0xCA)}
        self.table = _Table(memo)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, tokens: list[bytes], left: list[bool]) -> list[list[int]]:
        """Ids of different tokens."""
        tokenize, shown = self.model.tokenize, self.shown
        out = [None if own else [t.id for t in tokenize(token.decode("latin-1").translate(shown))] for token, own in zip(tokens, left)]
        whole = [k for k, own in enumerate(left) if own]
        for k, ids in zip(whole, self._whole([tokens[k].decode() for k in whole])):
            out[k] = ids
        return out

    def encode(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has); data: the texts' UTF-8 bytes, starts: where each begins."""
        bounds = np.append(starts, len(data))
        if self.special.search(data):
            parts = [data[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            done = [np.array(self._whole([p.decode()])[0], np.uint32) if self.special.search(p) else self.encode(p, np.zeros(1, np.int64))[0] for p in parts]
            return np.concatenate([*done, np.zeros(0, np.uint32)]), np.fromiter(map(len, done), np.int64, len(done))
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        cuts = [0]
        while len(data) - cuts[-1] > 2 * _CHUNK and (place := _CUT.search(data, cuts[-1] + _CHUNK)):
            cuts.append(place.end() - 1)
        if len(cuts) > 1:  # a long text, in pieces
            places = np.unique(np.concatenate([starts[starts < len(data)], cuts]))
            done = [self.encode(data[a:b], places[(places >= a) & (places < b)] - a) for a, b in zip(cuts, [*cuts[1:], len(data)])]
            ends = np.append(0, np.cumsum(np.concatenate([n for _, n in done])))
            return np.concatenate([ids for ids, _ in done]), np.diff(ends[np.searchsorted(np.append(places, len(data)), bounds)])
        if self.table.n > self.table.most:
            self.table.renew()
        table = self.table
        padded = np.frombuffer(data + bytes(_KEPT_BYTES), np.uint8)
        at, sizes, left = _cut(padded[: len(data)], starts[starts < bounds[1:]])
        short = np.flatnonzero(sizes <= _KEPT_BYTES)
        keys = np.ndarray((len(data) + _KEPT_BYTES - 7,), "<u8", padded, 0, (1,))[at[short, None] + np.array([0, 8, 16])] & _KEY_MASKS[sizes[short]]
        kinds = sizes[short].astype(np.uint8) | left[short].view(np.uint8) << np.uint8(7)
        h = table.hashed(keys, kinds)
        entry = np.full(len(at), -1, np.int32)
        entry[short] = table.find(keys, kinds, h)
        new = np.flatnonzero(entry[short] < 0)
        _, one, back = np.unique(h[new], return_index=True, return_inverse=True)
        one = new[one]
        raw = lambda k: [data[s : s + n] for s, n in zip(at[k].tolist(), sizes[k].tolist())]
        added = table.append(keys[one], kinds[one], self._new(raw(short[one]), left[short[one]].tolist()))
        table.file(added, h[one])
        like = (keys[one[back]] == keys[new]).all(1) & (kinds[one[back]] == kinds[new])  # not so for other tokens of the same hash
        entry[short[new[like]]] = added[back[like]]
        n, n_ids = table.n, table.n_ids
        rest = np.flatnonzero(entry < 0)  # long ones, too
        if len(rest):
            tokens = list(zip(raw(rest), left[rest].tolist()))
            place = {t: k for k, t in enumerate(dict.fromkeys(tokens))}
            added = table.append(np.zeros((len(place), 3), np.uint64), np.zeros(len(place), np.uint8), self._new([t for t, _ in place], [own for _, own in place]))
            entry[rest] = added[[place[t] for t in tokens]]
        counts = table.counts[entry]
        ends = np.append(0, np.cumsum(counts))
        ids = table.ids[np.repeat(table.starts[entry] - ends[:-1], counts) + np.arange(ends[-1])]
        table.drop(n, n_ids)
        return ids, np.diff(ends[np.searchsorted(at, bounds)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, counts = self.encode(b"".join(raw), np.cumsum(sizes) - sizes)
        ends = np.cumsum(counts).tolist()
        return [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, counts.tolist())]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


FILE_SCHEMA = "part int, block long, start long, n_ids long, doc_ids array<long>, counts array<long>, words binary, marks binary"


def _slices(frames: Iterator[pd.DataFrame], characters: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in slices of about so many characters, so that a slice of long texts stays small."""
    for frame in frames:
        ids, texts, total = [], [], 0
        for i, t in zip(frame.iloc[:, 0].tolist(), frame.iloc[:, 1].tolist()):
            t = t or ""
            ids.append(None if i is None or i != i else int(i))
            texts.append(t)
            total += len(t)
            if total >= characters:
                yield ids, texts
                ids, texts, total = [], [], 0
        if ids:
            yield ids, texts


def _bytes_of(texts: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The UTF-8 bytes of a string array, and where each text begins and the last one ends."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    return data or pa.py_buffer(b""), np.frombuffer(offsets, "<i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)


def block(part: int, number: int, start: int, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> dict:
    """A row of a file."""
    words, first, place = simple8b_encode(ids)
    marked = np.arange(0, len(ids), MARK)
    pack = np.searchsorted(first, marked, side="right") - 1
    marks = np.stack([place[pack], marked - first[pack]], axis=1).astype("<u4") if len(ids) else np.zeros((0, 2), "<u4")
    return {
        "part": part, "block": number, "start": start, "n_ids": len(ids), "doc_ids": doc_ids, "counts": pa.array(counts, pa.int64()),
        "words": words.astype("<u8").tobytes(), "marks": marks.tobytes(),
    }


def ids_between(words: bytes, marks: bytes, a: int, b: int) -> np.ndarray:
    """The ids from place ``a`` to place ``b`` of a block, decoded from the last mark before them and no further."""
    place = np.frombuffer(marks, "<u4").reshape(-1, 2)
    head, within = (int(x) for x in place[a // MARK]) if b > a else (0, 0)
    last = -(-b // MARK)
    stop = int(place[last, 0]) + int(place[last, 1] > 0) if last < len(place) else None  # the next mark's word, if it begins before
    skip = a % MARK + within
    return simple8b_decode(np.frombuffer(words, "<u8")[head:stop], skip + b - a)[skip:] if b > a else np.zeros(0, np.uint64)


_KINDS_OF = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
_FILE = pa.schema([(n, _KINDS_OF[k]) for n, k in (c.split() for c in FILE_SCHEMA.split(", "))])


def _rows(blocks: list[dict]) -> pa.RecordBatch:
    columns = []
    for field in _FILE:
        values = [b[field.name] for b in blocks]
        if pa.types.is_list(field.type):
            offsets = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(values)))
        else:
            columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=_FILE)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode the texts, end each with ``end_id`` and write them under ``path`` in ascending doc_id order.

    A null text is an empty one; null ids come first; rows with equal ids are ordered by text. Texts are
    dealt by ranges of ids (and of text hashes, so that one very frequent id doesn't fill a task).
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Document ids, how many token ids each has and these, for some texts at once."""
        encode = _tokenizer(tokenizer).encode
        for batch in batches:
            data, bounds = _bytes_of(batch.column(1))
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _CHUNK, "right")) - 1)
                ids, counts = encode(data[int(bounds[a]) : int(bounds[b])].to_pybytes(), bounds[a:b] - bounds[a])
                ended = np.cumsum(counts + 1)
                out = np.full(int(ended[-1]), end_id, np.uint32)
                inner = np.ones(len(out), bool)
                inner[ended - 1] = False
                out[inner] = ids
                yield batch.column(0)[a:b], counts + 1, out
                a = b

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start, held = TaskContext.get().partitionId(), 0, 0, 0
        names, counts, ids = [], [], []
        for own, n, tokens in encoded(batches):
            ends, a, at, out = np.cumsum(n), 0, 0, []
            while a < len(n):
                last = int(np.searchsorted(ends, at + block_ids - held))  # the document that fills the block
                b = min(last + 1, len(n))
                names.append(own[a:b])
                counts.append(n[a:b])
                ids.append(tokens[at : ends[b - 1]])
                held += int(ends[b - 1]) - at
                a, at = b, int(ends[b - 1])
                if last < len(n):
                    out.append(block(part, number, start, pa.concat_arrays(names), np.concatenate(counts), np.concatenate(ids)))
                    names, counts, ids, held, number, start = [], [], [], 0, number + 1, start + held
            if out:
                yield _rows(out)
        if names:
            yield _rows([block(part, number, start, pa.concat_arrays(names), np.concatenate(counts), np.concatenate(ids))])

    order = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"), F.xxhash64(text).alias("h"))
    order = order.repartitionByRange("d", "h").sortWithinPartitions("d", "h", "t").select("d", "t")
    order.mapInArrow(blocks, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def _starts(files: DataFrame) -> DataFrame:
    """part and before: the ids of all parts that come earlier; summed up in two levels."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("coarse", F.shiftright("part", 8))
    earlier = lambda *by: Window.partitionBy(*by[1:]).orderBy(by[0]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = totals.groupBy("coarse").agg(F.sum("n").alias("all")).select("coarse", F.coalesce(F.sum("all").over(earlier("coarse")), F.lit(0)).alias("base"))
    own = totals.select("part", "coarse", F.coalesce(F.sum("n").over(earlier("part", "coarse")), F.lit(0)).alias("own"))
    return own.join(coarse, "coarse").select("part", (F.col("base") + F.col("own")).alias("before"))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    ids are binary, little-endian unsigned 32-bit; ids_crc32 is their unsigned CRC-32.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                before, start, n_ids, names, counts, words = (c[row] for c in batch.columns)
                counts = counts.values.to_numpy()
                ends = np.cumsum(counts)
                ids = memoryview(simple8b_decode(np.frombuffer(words.as_buffer(), "<u8"), n_ids.as_py()).astype("<u4").view(np.uint8))
                pieces = [ids[4 * (b - n) : 4 * b] for b, n in zip(ends.tolist(), counts.tolist())]
                columns = [names.values, pa.array(before.as_py() + start.as_py() + ends - counts), pa.array(counts), pa.array(list(map(zlib.crc32, pieces)), pa.int64())]
                named = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(list(map(bytes, pieces)), pa.binary())] * with_ids, named + ["ids"] * with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    starts = checkpoint(_starts(files))
    if starts.count() <= BROADCAST_PARTS:  # so that no block moves
        starts = F.broadcast(starts)
    return files.join(starts, "part").select("before", "start", "n_ids", "doc_ids", "counts", "words").mapInArrow(unpacked, schema)


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids (binary) of the documents whose ids are in ``wanted`` (doc_id), all rows of each; nothing else of their blocks is decoded."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    places = files.select("part", "block", F.posexplode("doc_ids").alias("k", "doc_id")).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = files.join(places.groupBy("part", "block").agg(F.array_sort(F.collect_list("k")).alias("asked")), ["part", "block"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                names, counts, words, marks, k = (c[row] for c in batch.columns)
                counts, k = counts.values.to_numpy(), k.values
                ends = np.cumsum(counts)
                ids = [ids_between(words.as_buffer(), marks.as_buffer(), int(ends[j] - counts[j]), int(ends[j])).astype("<u4").tobytes() for j in k.to_pylist()]
                yield pa.RecordBatch.from_arrays([names.values.take(k), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return asked.select("doc_ids", "counts", "words", "marks", "asked").mapInArrow(unpacked, "doc_id long, ids binary")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Write the documents' ids to files and read them back, see ``read_token_files``; path: a new shared folder by default.

    An empty table gives no rows. Repeated rows are documents like any other.
    """
    spark = docs.sparkSession
    path = path or f"{checkpoint_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id, doc_id, text)
    return read_token_files(spark, path, with_ids)
