"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. What toxic texts share
with ordinary ones tells nothing, so the toxic one is trained on what they have beyond those (their words
that hold byte strings which ordinary texts hold far more seldom), and windows are compressed with the
ordinary dictionary alone and with the toxic one after it; blanks make up the difference in length.
A window that comes out shorter with the toxic dictionary speaks for toxicity. A document's differences
are summed up in a few figures (largest, mean of the largest, shares above thresholds), and a logistic
model makes the score of them; it is calibrated on figures from dictionaries that were not trained on the
documents at hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

#: Labelled documents of each class that the model is fitted on, about. Of a text with more characters, evenly spaced excerpts of so many together count.
SAMPLE_PER_CLASS, SAMPLE_CHARACTERS, EXCERPTS = 4000, 8000, 8
WINDOW_WORDS = 8
#: Bytes of the ordinary and the toxic dictionary, and of the segments that each is trained in.
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_SEGMENT, TOXIC_SEGMENT = 1 << 15, 1 << 12, 200, 16
#: Lengths of the byte strings, their least G and the least ratio of their frequency in toxic text to that in ordinary text.
GRAMS, LEAST_G, LEAST_RATIO = (5, 6), 18.0, 5.0
LEVEL = 13
_FEATURES = 9


def windows(text: str | None) -> list[bytes]:
    """Consecutive windows that cover the whole text, lower-cased; an empty text has one without words."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return [b" " + b" ".join(words[k : k + WINDOW_WORDS]) + b" " for k in range(0, max(1, len(words)), WINDOW_WORDS)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    form = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=form)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=form)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    _pair: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, from the differences of its windows."""
        if self._pair is None:
            self._pair = _compressor(self.ordinary).compress, _compressor(self.toxic).compress
        plain, toxic = self._pair
        out = np.zeros((len(texts), _FEATURES))
        for k, text in enumerate(texts):
            d = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], float)
            q = np.sort(d)[::-1]
            n = len(d)
            four, five = (d >= 4).sum(), (d >= 5).sum()
            out[k] = q[0], q[:2].mean(), q[:4].mean(), d.mean(), (d >= 3).mean(), four**0.5, five / n, five**0.5, np.log(n)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _contexts(texts: list[str], places: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(the texts' words by their place in ``places``, which grows; how many different neighbours each word has, on the side where they are fewer).

    In a passage that several texts share a word has the same neighbour on one side at least, so it counts once.
    """
    words = (w for t in texts for w in (b"", *t.lower().encode("utf-8", "surrogatepass").split(), b""))
    at = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int32).astype(np.int64)
    inner = np.flatnonzero(at[1:-1] > 0) + 1
    near = [np.unique(at[inner] << 32 | at[inner + side]) >> 32 for side in (-1, 1)]
    return at, np.minimum(*(np.bincount(x, minlength=len(places)) for x in near))


def _strings(words: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte strings of ``size`` within words, a space on either side, as numbers; the word of each), some words at once."""
    for a in range(0, len(words), 1 << 16):
        part = words[a : a + (1 << 16)]
        flat = np.frombuffer(b"".join(b" %b " % w for w in part), np.uint8).astype(np.uint64)
        word = np.repeat(np.arange(a, a + len(part)), [len(w) + 2 for w in part])
        if len(flat) >= size:
            codes = np.zeros(len(flat) - size + 1, np.uint64)
            for k in range(size):
                codes = (codes << np.uint64(8)) | flat[k : k + len(codes)]
            own = word[: len(codes)] == word[size - 1 :]
            yield codes[own], word[: len(codes)][own]


def _marked(words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Whether a word holds a byte string that marks toxic text; toxic, ordinary: how often each word occurs."""
    out = np.zeros(len(words), bool)
    n, m = max(1, toxic.sum()), max(1, ordinary.sum())

    def likelihood(k: np.ndarray, of: int, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (of - k) * np.log(1 - p)

    mine = np.flatnonzero(toxic)
    mine_words = [words[k] for k in mine.tolist()]
    for size in GRAMS:
        grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(c) for c, _ in _strings(mine_words, size))]))
        if not len(grams):
            continue
        here, there = np.zeros(len(grams)), np.zeros(len(grams))
        for codes, word in _strings(words, size):
            at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
            hit = grams[at] == codes
            here += np.bincount(at[hit], weights=toxic[word[hit]], minlength=len(grams))
            there += np.bincount(at[hit], weights=ordinary[word[hit]], minlength=len(grams))
        both = (here + there) / (n + m)
        g = 2 * (likelihood(here, n, here / n) + likelihood(there, m, there / m) - likelihood(here, n, both) - likelihood(there, m, both))
        good = grams[(g > LEAST_G) & (here / n > LEAST_RATIO * there / m)]
        for codes, word in _strings(mine_words, size):
            out[mine[word[np.isin(codes, good)]]] = True
    return out


def toxic_stretches(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Of each toxic text, the words that hold what toxic texts have beyond ordinary ones."""
    places: dict[bytes, int] = {b"": 0}
    at, here = _contexts(toxic, places)
    _, there = _contexts(ordinary, places)
    words = list(places)
    marked = np.append(False, _marked(words[1:], np.pad(here, (0, len(words) - len(here)))[1:], there[1:]))
    text = np.cumsum(at == 0) // 2
    own = np.flatnonzero(marked[at])
    return [b" " + b" ".join(words[k] for k in part) + b" " for part in np.split(at[own], np.flatnonzero(np.diff(text[own])) + 1) if len(part)]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary trained on the samples, ``size`` bytes; the samples themselves where they are too few."""
    try:
        out = zstandard.train_dictionary(size, samples, k=segment, d=6, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        out = b"".join(samples)
    return out[-size:].rjust(size)


def _joined(samples: list[bytes], n: int) -> list[bytes]:
    """Short samples, ``n`` in one, as training needs some length."""
    return [b"".join(samples[k : k + n]) for k in range(0, len(samples), n)]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.r_[np.full(len(w) - 1, 1e-1), 1e-3]
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * np.r_[w[:-1], 0])
        w += np.clip(step, -2, 2)
        w[: _FEATURES - 1] = np.maximum(w[: _FEATURES - 1], 0)  # a shorter toxic form never speaks against toxicity
    return w


def _dictionaries(toxic: list[str], plain: list[str]) -> Model:
    ordinary = _trained(_joined([w for t in plain or ["-"] for w in windows(t)], 16), ORDINARY_BYTES, ORDINARY_SEGMENT)
    own = _trained(_joined(toxic_stretches(toxic, plain), 4), TOXIC_BYTES, TOXIC_SEGMENT)
    return Model(ordinary + b" " * TOXIC_BYTES, ordinary + own, np.zeros(_FEATURES), np.ones(_FEATURES), np.zeros(_FEATURES + 1))


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Dictionaries of all rows, calibrated on figures that dictionaries of the other half give for each half.

    Without documents of both classes, every score is the share of toxic ones (a half if none is labelled).
    """
    rows = sorted(zip(toxic, texts))
    # neighbours in this order, which may be near copies, stay together
    halves = [[r for k, r in enumerate(rows) if k // 16 % 2 == h] for h in (0, 1)]

    def trained(part: list[tuple[int, str]]) -> Model:
        return _dictionaries([t for y, t in part if y == 1], [t for y, t in part if y == 0])

    model = trained(rows)
    y = np.array([r[0] for h in halves for r in h], float)
    if all({0, 1} == {r[0] for r in h} for h in halves):
        x = np.concatenate([trained(other).features([t for _, t in own]) for own, other in (halves, halves[::-1])])
        model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
        model.weights = _logistic((x - model.mean) / model.scale, y)
    else:
        share = (y.sum() + 0.5) / (len(y) + 1)
        model.weights[-1] = np.log(share / (1 - share))
    return model


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model of about ``per_class`` labelled documents of each class, chosen by a hash of their ids.

    labels: doc_id and toxic (0 or 1; the larger of several, null ones left out). Of a text of over
    SAMPLE_CHARACTERS characters, EXCERPTS evenly spaced excerpts are looked at; scores are of whole texts.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # at most about 2 x per_class ids, whatever the input: safe to broadcast
    chosen = F.broadcast(bounded_sample(known, "toxic", per_class, "doc_id").withColumnRenamed("doc_id", "id"))
    size = SAMPLE_CHARACTERS // EXCERPTS
    pieces = F.transform(F.sequence(F.lit(0), F.lit(EXCERPTS - 1)), lambda k: F.substring("t", (k * (F.length("t") - size) / (EXCERPTS - 1)).cast("int") + 1, F.lit(size)))
    excerpt = F.when(F.length("t") <= SAMPLE_CHARACTERS, F.col("t")).otherwise(F.array_join(pieces, " "))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).filter("t is not null").join(chosen, "id").select(excerpt.alias("t"), "toxic").collect()
    return fit([r.t for r in rows], [r.toxic for r in rows])


def score(model: Model, text: Column) -> Column:
    """The score of each whole text, from 0 to 1; a null text is scored as an empty one."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return of(text)


def detect(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 from 0.5 up) of every row; no row moves, null ids and repeated rows stay."""
    found = docs.select(F.col(doc_id).alias("doc_id"), score(model, F.col(text)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
