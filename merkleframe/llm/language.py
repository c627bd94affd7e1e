"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds its letters' vectors, rotated by their
place (twice, once, not at all), by multiplication; a text bundles the vectors of its trigrams by
addition, and a language's prototype bundles the texts of that language, each at unit length. A text has
the language whose prototype it is nearest to by cosine. What all languages share is taken out of the
prototypes and the texts alike: the mean of the prototypes, in proportion to the text's share of it.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

DIMENSIONS = 1024
#: Texts of each language that the prototypes are bundled from, about.
SAMPLE_PER_LANGUAGE = 4000
UNKNOWN = "und"
_SEED = 20240229
#: Characters that are looked at together.
_CHARACTERS = 1 << 18
#: Texts whose bundles are held at once.
_TEXTS = 1024
#: Trigram vectors, and letter vectors, that a worker keeps.
_KEPT, _LETTERS = 1 << 14, 1 << 15
#: Letters are code points below this one.
_POINTS = 0x33480


def _letter_table() -> np.ndarray:
    """The code point of each letter; 0 for anything else."""
    table = np.zeros(0x110000, np.int64)
    letters = [c for c in range(_POINTS) if unicodedata.category(chr(c))[0] == "L"]
    table[letters] = letters
    return table


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of three arrays of letters, as letters in 21 bits each, and the place of each trigram among them."""
    dense = np.zeros(_POINTS, np.int64)
    for p in parts:
        dense[p] = 1
    used = np.flatnonzero(dense)
    n = len(used)
    dense[used] = np.arange(n)
    small = (dense[parts[0]] * n + dense[parts[1]]) * n + dense[parts[2]]
    if n**3 > 1 << 22:
        there, place = np.unique(small, return_inverse=True)
    else:  # without a sort where few letters occur
        there = np.flatnonzero(np.bincount(small, minlength=n**3))
        at = np.zeros(n**3, np.int64)
        at[there] = np.arange(len(there))
        place = at[small]
    return used[there // n**2 if n else there] << 42 | used[there // n % n if n else there] << 21 | used[there % n if n else there], place


class Trigrams:
    """Bundles of the trigrams of whole texts."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.table, self.dimensions = _letter_table(), dimensions
        self.letters: dict[int, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.codes = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, self.dimensions), np.float32)

    def letter(self, point: int) -> np.ndarray:
        """The random vector of a letter, drawn by its code point; 0 stands for anything else."""
        if point not in self.letters:
            if len(self.letters) >= _LETTERS:
                self.letters = {}
            self.letters[point] = np.random.default_rng([_SEED, point]).integers(0, 2, self.dimensions).astype(np.int8) * 2 - 1
        return self.letters[point]

    def _bound(self, codes: np.ndarray) -> np.ndarray:
        """Each trigram's letters, rotated by their place and multiplied."""
        out = np.ones((len(codes), self.dimensions), np.int8)
        for place, turn in ((42, 2), (21, 1), (0, 0)):
            points, at = np.unique(codes >> place & 0x1FFFFF, return_inverse=True)
            if len(points):
                out *= np.roll(np.stack([self.letter(p) for p in points.tolist()]), turn, axis=1)[at]
        return out.astype(np.float32)

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        """Bound vectors of sorted different trigrams."""
        if len(self.codes) + len(codes) > _KEPT:
            self._forget()
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        made = self._bound(codes[~known])
        if len(codes) > _KEPT:  # too many to keep
            return made
        if len(made):
            self.codes = np.concatenate([self.codes, codes[~known]])
            order = np.argsort(self.codes, kind="stable")
            self.codes, self.vectors = self.codes[order], np.concatenate([self.vectors, made])[order]
            at = np.searchsorted(self.codes, codes)
        return self.vectors[at]

    def _slice(self, texts: list[str], before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bundles and letters of texts in lower case; ``before``, ``after``: whether a text's first or last character is there for its neighbour only."""
        points = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.flatnonzero(points == 0)  # texts have no NUL of their own, see bundles()
        inner = np.ones(len(points), bool)
        inner[ends[:-1][before] + 1] = inner[ends[1:][after] - 1] = False
        classes, owner = self.table[points], np.repeat(np.arange(-1, len(texts) + 1), np.diff([0, *ends, len(points)]))
        own = (classes > 0) | (np.append(1, classes[:-1]) > 0)  # runs of other characters count once
        classes, owner, inner = classes[own], owner[own], inner[own]
        good = (classes[1:-1] > 0) & inner[1:-1]
        owner = owner[1:-1][good]
        letters = np.bincount(owner, minlength=len(texts))
        distinct, inverse = _distinct([classes[:-2][good], classes[1:-1][good], classes[2:][good]])
        counts = np.bincount(owner * len(distinct) + inverse, minlength=len(texts) * len(distinct)).reshape(len(texts), len(distinct)).astype(np.float32)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for k in range(0, len(distinct), _KEPT // 2):
            part = slice(k, k + _KEPT // 2)
            out += counts[:, part] @ self._vectors(distinct[part])
        return out, letters

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The bundle and the number of letters of each text; texts of any length go through in slices."""
        out, letters = np.zeros((len(texts), self.dimensions), np.float32), np.zeros(len(texts), np.int64)
        pieces: list[tuple[int, str, bool, bool]] = []
        for k, t in enumerate(texts):
            t = (t or "").replace("\0", " ").lower()
            for a in range(0, len(t), _CHARACTERS):  # with the characters next to a cut
                b = a + _CHARACTERS
                pieces.append((k, t[max(0, a - 1) : b + 1], a > 0, b < len(t)))
        start = 0
        while start < len(pieces):
            stop, total = start, 0
            while stop < len(pieces) and (stop == start or (total + len(pieces[stop][1]) <= _CHARACTERS and stop - start < 256)):
                total += len(pieces[stop][1])
                stop += 1
            owners, parts, before, after = zip(*pieces[start:stop])
            b, n = self._slice(list(parts), np.array(before), np.array(after))
            np.add.at(out, list(owners), b)
            np.add.at(letters, list(owners), n)
            start = stop
        return out, letters


_TRIGRAMS: dict[int, Trigrams] = {}


def _trigrams(dimensions: int) -> Trigrams:
    if dimensions not in _TRIGRAMS:
        _TRIGRAMS[dimensions] = Trigrams(dimensions)
    return _TRIGRAMS[dimensions]


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Prototypes of the learned languages, in the order of their names."""

    def __init__(self, names: list[str], sums: np.ndarray):
        self.names, self.sums = names, sums
        unit = _units(sums.astype(np.float32)) if len(names) else sums.astype(np.float32)
        self.mean = _units(unit.mean(0, keepdims=True))[0] if len(names) > 1 else np.zeros(sums.shape[1], np.float32)
        self.prototypes = _units(self._without(unit)) if len(names) else unit

    def _without(self, x: np.ndarray) -> np.ndarray:
        return x - (x @ self.mean)[:, None] * self.mean

    def likeness(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cosine of each text with each language before the mean is taken out, the length class (log2 of the letters) and the place of the predicted language."""
        parts = [self._likeness(texts[k : k + _TEXTS]) for k in range(0, max(1, len(texts)), _TEXTS)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _likeness(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bundles, letters = _trigrams(self.sums.shape[1]).bundles(texts)
        best = (_units(self._without(bundles)) @ self.prototypes.T).argmax(1)
        return _units(bundles) @ _units(self.sums.astype(np.float32)).T, np.log2(np.maximum(1, letters)).astype(int), np.where(letters > 0, best, -1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text."""
        parts = [self._predict(texts[k : k + _TEXTS]) for k in range(0, max(1, len(texts)), _TEXTS)]
        return [name for names, _ in parts for name in names], np.concatenate([scores for _, scores in parts])

    def _predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        bundles, letters = _trigrams(self.sums.shape[1]).bundles(texts)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        near = _units(self._without(bundles)) @ self.prototypes.T
        best = near.argmax(1)
        found = letters > 0
        score = np.where(found, np.clip(near[np.arange(len(texts)), best], 0, 1), 0).astype(float)
        return [self.names[b] if f else UNKNOWN for b, f in zip(best.tolist(), found.tolist())], score


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, dimensions: int = DIMENSIONS) -> Model:
    """Prototypes from about ``per_language`` texts of each language, chosen by a hash of id and text.

    Rows with a null language or text are left out. The texts stay on the executors; the driver gets one
    vector per language.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter("t is not null and l is not null")
    rows = bounded_sample(rows, "l", per_language, "d", "t")

    def bundled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for k in range(0, len(frame), _TEXTS):
                part = frame.iloc[k : k + _TEXTS]
                unit = _units(_trigrams(dimensions).bundles(part["t"].tolist())[0])
                for name, own in part.groupby("l", sort=False).indices.items():
                    sums[name] = sums.get(name, 0) + unit[own].astype(np.float64).sum(0)
        if sums:
            yield pd.DataFrame({"l": [n for n in sums for _ in range(dimensions)], "k": list(range(dimensions)) * len(sums), "x": np.concatenate([*sums.values()])})

    # decimals: the sum doesn't depend on the order of the tasks
    total = rows.select("l", "t").mapInPandas(bundled, "l string, k int, x double").groupBy("l", "k").agg(F.sum(F.col("x").cast("decimal(28,10)")).cast("double").alias("x"))
    found = total.groupBy("l").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s.x).alias("x")).collect()
    found = sorted(found, key=lambda r: r.l)
    return Model([r.l for r in found], np.array([r.x for r in found]).reshape(len(found), dimensions))


#: Length classes, the texts of a language that a limit needs, the share of them under it, and its least distance below their median, in standard deviations.
LENGTHS, ENOUGH, UNDER, BELOW = 40, 20, 0.001, 6.0


def limits(model: Model, docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> np.ndarray:
    """The least cosine (language, length class) of a text in a learned language, from the texts that learn() takes.

    A share UNDER of them at most lies below it, and it is BELOW robust deviations under their median or further, so odd texts of a language (tables, repetitions) stay too. A class with few texts has the limit of the next
    shorter one that has enough (or else of the next longer one); a language without any takes 0.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter("t is not null and l is not null")
    rows = bounded_sample(rows, "l", per_language, "d", "t")
    names, sums = model.names, model.sums

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(names, sums)
        place = {n: k for k, n in enumerate(names)}
        for frame in frames:
            if len(frame):
                near, length, best = own.likeness(frame["t"].tolist())
                at = frame["l"].map(place).to_numpy()
                out = pd.DataFrame({"l": at, "n": length, "x": near[np.arange(len(at)), at].astype(float)})
                yield out[best >= 0]

    stats = rows.select("t", "l").mapInPandas(measured, "l int, n int, x double").groupBy("l", "n").agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("x", [UNDER, 0.25, 0.5], 10000).alias("q"))
    out = np.full((len(names), LENGTHS), np.nan)
    for r in stats.filter(F.col("rows") >= ENOUGH).collect():
        out[r.l, min(r.n, LENGTHS - 1)] = min(r.q[0], r.q[2] - BELOW * (r.q[2] - r.q[1]) / 0.6745)
    return np.maximum(0, pd.DataFrame(out.T).ffill().bfill().fillna(0).to_numpy().T)


def recognised(model: Model, least: np.ndarray, text: Column) -> Column:
    """Whether a text has letters and is as like its predicted language as limits() asks."""
    names, sums = json.dumps(model.names), model.sums
    cache: list[Model] = []

    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        if not cache:
            cache.append(Model(json.loads(names), sums))
        near, length, best = cache[0].likeness(texts.tolist())
        return pd.Series((best >= 0) & (near[np.arange(len(best)), best] >= least[best, np.minimum(length, LENGTHS - 1)]) & (near.max(1) > 0), dtype=bool)

    return of(text)


def predicted(model: Model, text: Column) -> Column:
    """A struct of lang_pred and score of each whole text; ``und`` and 0 if it is null or has no letter."""
    names, sums = json.dumps(model.names), model.sums
    cache: list[Model] = []

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        if not cache:
            cache.append(Model(json.loads(names), sums))
        langs, scores = cache[0].predict(texts.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return of(text)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row; no row moves, null ids and repeated rows stay."""
    found = docs.select(F.col(doc_id).alias("doc_id"), predicted(model, F.col(text)).alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score")
