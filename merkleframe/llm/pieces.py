"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

Pieces never have a meta symbol after another character, so words (runs of meta symbols with what
follows) are encoded on their own and each different word once. The new words of a batch lie as symbols
in one flat array, cut further wherever no piece holds the two neighbouring characters. Each round finds
every stretch's best pair with a segmented minimum over the ranks of its pairs, merges it at the leftmost
place in all stretches at once, and takes out those without a pair.

A rank's later occurrences in a stretch are merged in the same round where that can't change the result:
when no piece that contains the merged piece at an end ranks before it, no merge can come in between, so
the library's queue would take them one after the other. Where there is such a piece, what may come in
between stays within characters that better pieces hold side by side, so the first place after a pair of
neighbours that no better piece holds is merged too. Runs of meta symbols, whose pieces all rank last and
alike, are merged at the end, from the left.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenids import _slices

META = "▁"
_NEVER = np.iinfo(np.int32).max
#: Words whose ids are remembered within a worker.
MEMO = 600_000
#: Characters of the longest word that is remembered.
KEPT = 256
#: Symbols that are merged at once, so that memory stays bounded.
_FLAT = 1 << 20


class _Ranks:
    """Ranks by pairs of symbols, in an open-addressing hash table."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.keys, self.ranks = np.append(keys, -1), np.append(ranks, np.int32(_NEVER))
        self.shift = np.uint64(64 - (16 * len(keys)).bit_length())
        self.slots = np.full(1 << (64 - int(self.shift)), len(keys), np.int32)
        entry, slot = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(entry):
            free = self.slots[slot] == len(keys)
            self.slots[slot[free]] = entry[free]
            lost = self.slots[slot] != entry
            entry, slot = entry[lost], (slot[lost] + 1) % len(self.slots)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each key and its place, _NEVER and the last place where there is none."""
        slot = self._slots(wanted)
        out = self.slots[slot]
        todo = np.flatnonzero((self.keys[out] != wanted) & (out < len(self.keys) - 1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % len(self.slots)
            out[todo] = self.slots[slot[todo]]
            todo = todo[(self.keys[out[todo]] != wanted[todo]) & (out[todo] < len(self.keys) - 1)]
        return self.ranks[out], out


class PieceEncoder:
    """Encodes as the library does with the same model: normalised by it, BPE, byte fallback, no sampling."""

    _word = re.compile(f"{META}*[^{META}]+|{META}+")

    def __init__(self, path: str, memo: int = MEMO):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        self.most, self.memo = memo, {}
        size = sp.get_piece_size()
        special = [sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k) for k in range(size)]
        pieces = [sp.id_to_piece(k) for k in range(size)]
        self.bytes_of = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype="<u4")
        self.bos = np.array([sp.bos_id()], "<u4").tobytes() if sp.bos_id() >= 0 else b""
        self.eos = np.array([sp.eos_id()], "<u4").tobytes() if sp.eos_id() >= 0 else b""
        # symbols: pieces by id, then characters that occur in pieces without being one
        self.symbol = {p: k for k, p in enumerate(pieces) if not special[k]}
        if any(META in p.lstrip(META) for p in self.symbol):
            raise ValueError("a piece joins words: this model can't be encoded word by word")
        for c in sorted({c for p in self.symbol for c in p} - self.symbol.keys()):
            self.symbol[c] = size + len(self.symbol)
        self.n_pieces, self.other = size, 2 * size + len(self.symbol) + 1
        self.of_character = np.full(0x110000, self.other, np.int64)
        for p, k in self.symbol.items():
            if len(p) == 1:
                self.of_character[ord(p)] = k
        order_of = sorted({-sp.get_score(k) for p, k in self.symbol.items() if k < size and len(p) > 1})
        place = {s: r for r, s in enumerate(order_of)}
        rank_of = {p: place[-sp.get_score(k)] for p, k in self.symbol.items() if k < size and len(p) > 1}
        shared = np.bincount(list(rank_of.values()), minlength=len(order_of)) > 1
        keys, ranks, results = [], [], []
        once = {p for p, r in rank_of.items() if shared[r]}
        for p, r in rank_of.items():
            for cut in range(1, len(p)):
                left, right = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.other + right)
                    ranks.append(r)
                    results.append(self.symbol[p])
                    once.update(x for x in (p[:cut], p[cut:]) if rank_of.get(x, -1) > r)
        self.pieces = _Ranks(np.array(keys, np.int64), np.array(ranks, np.int32))
        self.results = np.array([*results, 0], np.int64)
        self.one_by_one = np.zeros(self.other + 1, bool)
        self.one_by_one[[self.symbol[p] for p in once]] = True
        # the best rank of the pieces that hold two characters side by side
        beside: dict[int, int] = {}
        for p, r in rank_of.items():
            for x, y in zip(p, p[1:]):
                key = self.symbol[x] * self.other + self.symbol[y]
                beside[key] = min(r, beside.get(key, r))
        self.beside = _Ranks(np.array(list(beside), np.int64), np.array(list(beside.values()), np.int32))
        # runs of meta symbols: their pieces alone rank last, and no other piece begins with two
        runs = {len(p): self.symbol[p] for p in self.symbol if p == META * len(p)}
        alike = {rank_of[p] for p in rank_of if p == META * len(p)}
        only = len(alike) == 1 and all((rank_of[p] in alike) == (p == META * len(p)) and (p == META * len(p) or not p.startswith(META * 2)) for p in rank_of)
        self.runs, self.run_rank = runs, max(alike) if only and max(alike) == len(order_of) - 1 else -1

    def _run(self, n: int) -> np.ndarray:
        """The symbols of a run of ``n`` meta symbols, merged from the left."""
        out: list[int] = []
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in self.runs:
                out[-2:] = [out[-2] + out[-1]]
        return np.array([self.runs[k] for k in out], np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, at = self.pieces.find(left * self.other + right)
        return rank, self.results[at]

    def _merged(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols of all words and how many each has; symbols: those of all words, one after the other."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        beside = self.beside.find(symbols[:-1] * self.other + symbols[1:])[0]
        beside[word[:-1] != word[1:]] = _NEVER
        owner = word[np.append(0, np.flatnonzero(beside == _NEVER) + 1)] if len(word) else word  # of each stretch
        word = np.append(0, np.cumsum(beside == _NEVER))[: len(symbols)]
        rank, result = self._pairs(symbols[:-1], symbols[1:])
        rank[word[:-1] != word[1:]] = _NEVER
        rank, result, beside = np.append(rank, np.int32(_NEVER)), np.append(result, 0), np.append(beside, np.int32(_NEVER))
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            for k in np.flatnonzero(best == self.run_rank).tolist():
                a, b = starts[k], starts[k + 1] if k + 1 < len(starts) else len(symbols)
                n = int(np.argmax(np.append(symbols[a:b] != self.runs[1], True)))
                own = np.concatenate([self._run(n), symbols[a + n : b]])
                finished.append((own, np.full(len(own), word[a])))
            done = best == _NEVER
            gone = done | (best == self.run_rank)
            if gone.any():
                sizes = np.diff(np.append(starts, len(symbols)))
                out = np.repeat(done, sizes)
                finished.append((symbols[out], word[out]))
                keep = np.repeat(~gone, sizes)
                symbols, word, rank, result, beside = symbols[keep], word[keep], rank[keep], result[keep], beside[keep]
                best = best[~gone]
                if not len(symbols):
                    break
                starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            bests = np.repeat(best, np.diff(np.append(starts, len(symbols))))
            at = np.flatnonzero(rank == bests)
            own = word[at]
            leftmost = np.append(True, own[1:] != own[:-1])
            if not leftmost.all():
                # overlapping places alternate from the left; a later place needs a merge that no other can disturb
                run = np.append(True, (at[1:] != at[:-1] + 1) | leftmost[1:])
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                lone = self.one_by_one[result[at]]
                apart = leftmost.copy()
                if lone.any():
                    walls = np.append(0, np.cumsum(beside >= bests))
                    apart[1:] |= walls[at[1:]] > walls[at[:-1] + 1]
                at = at[apart | (~lone & (since % 2 == 0))]
            symbols[at] = result[at]
            beside[at] = beside[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            symbols, word, rank, result, beside = symbols[keep], word[keep], rank[keep], result[keep], beside[keep]
            touched = np.zeros(len(symbols), bool)
            touched[at] = touched[at[at > 0] - 1] = True
            again = np.flatnonzero(touched)
            last = again == len(symbols) - 1
            pair = again[~last]
            r, x = self._pairs(symbols[pair], symbols[pair + 1])
            r[word[pair] != word[pair + 1]] = _NEVER
            rank[pair], result[pair] = r, x
            rank[again[last]] = _NEVER
        if not finished:
            return symbols, np.zeros(len(lengths), np.int64)
        flat, stretch = (np.concatenate(x) for x in zip(*finished))
        order = np.argsort(stretch, kind="stable")
        return flat[order], np.bincount(owner[stretch], minlength=len(lengths))

    def _ids(self, word: str, symbols: np.ndarray) -> bytes:
        out, at = [], 0
        names = self._names
        for s in symbols.tolist():
            if s == self.other:
                piece = word[at]
            elif s < self.n_pieces:
                out.append(s.to_bytes(4, "little"))
                at += len(names[s])
                continue
            else:
                piece = names[s]
            out.append(self.bytes_of[np.frombuffer(piece.encode(), np.uint8)].tobytes())
            at += len(piece)
        return b"".join(out)

    @property
    def _names(self) -> dict[int, str]:
        if not hasattr(self, "_by_symbol"):
            self._by_symbol = {k: p for p, k in self.symbol.items()}
        return self._by_symbol

    def _learn(self, words: list[str]) -> None:
        start = 0
        while start < len(words):
            stop, total = start, 0
            while stop < len(words) and (stop == start or total + len(words[stop]) <= _FLAT):
                total += len(words[stop])
                stop += 1
            part = words[start:stop]
            codes = np.frombuffer("".join(part).encode("utf-32-le"), "<u4")
            symbols, counts = self._merged(self.of_character[codes], np.fromiter(map(len, part), np.int64, len(part)))
            ends = np.cumsum(counts)
            odd = np.zeros(len(part), bool)
            odd[np.searchsorted(ends, np.flatnonzero(symbols >= self.n_pieces), "right")] = True
            packed, known = symbols.astype("<u4").tobytes(), self.memo
            known.update(zip(part, [packed[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]))
            for k in np.flatnonzero(odd).tolist():
                known[part[k]] = self._ids(part[k], symbols[ends[k] - counts[k] : ends[k]])
            start = stop

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text, with begin and end ids."""
        split = [self._word.findall(self.library.normalize(t)) for t in texts]
        if len(self.memo) > self.most:
            self.memo = {}
        new = list(set().union(*split) - self.memo.keys())
        self._learn(new)
        of = self.memo.__getitem__
        out = [self.bos + b"".join(map(of, w)) + self.eos for w in split]
        for word in new:
            if len(word) > KEPT:
                del self.memo[word]
        return out

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit, with begin and end ids).

    A null text is an empty one, which has the begin and end ids only. No row moves: each task encodes
    the whole texts of its own input. Null ids and repeated rows stay as they are.
    """

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(model)
        for names, texts in _slices(frames, 1 << 21):
            ids = encode(texts)
            yield pd.DataFrame({"doc_id": pd.array(names, dtype="Int64"), "n_tokens": [len(i) // 4 for i in ids], "ids": ids})

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInPandas(encoded, "doc_id long, n_tokens long, ids binary")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """Rows of ``encode_pieces`` with a column decoded (string)."""

    def decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = _encoder(model).decode
        for frame in frames:
            yield frame.assign(decoded=[decode(i) for i in frame["ids"]])

    return encoded.mapInPandas(decoded, "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, encoded and decoded in one pass."""

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(model)
        for names, texts in _slices(frames, 1 << 21):
            ids = encode(texts)
            yield pd.DataFrame({
                "doc_id": pd.array(names, dtype="Int64"),
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(encode.decode(i).encode("utf-8")).hexdigest() for i in ids],
            })

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInPandas(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
