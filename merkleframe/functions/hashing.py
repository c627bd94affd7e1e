"""Digest functions by name: built-in expressions, BLAKE3, and any that is registered."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .blake3 import blake3, blake3_stream

T = TypeVar("T")
#: BLAKE3 inputs of so many bytes at most are hashed together, some 4 MiB or 4,096 inputs at a time.
SMALL, TOGETHER, MOST = 1 << 20, 1 << 22, 4096
_REGISTERED: dict[str, tuple[Callable[[Column], Column], Callable[[], object]]] = {}


def register(name: str, expression: Callable[[Column], Column], hasher: Callable[[], object]) -> None:
    """Add an algorithm: an expression from a binary column to a lower-case hex digest, and a hashlib-like constructor."""
    _REGISTERED[name.lower()] = (expression, hasher)


register("md5", F.md5, hashlib.md5)
register("sha1", F.sha1, hashlib.sha1)
register("sha256", lambda c: F.sha2(c, 256), hashlib.sha256)
register("sha224", lambda c: F.sha2(c, 224), hashlib.sha224)
register("sha384", lambda c: F.sha2(c, 384), hashlib.sha384)
register("sha512", lambda c: F.sha2(c, 512), hashlib.sha512)


def _name(algorithm: str) -> str:
    name = algorithm.lower().removesuffix("sum")
    if name in ("b3", "blake3"):
        return "blake3"
    if name not in _REGISTERED:
        raise ValueError(f"unknown digest {algorithm!r}; known: blake3, {', '.join(sorted(_REGISTERED))}")
    return name


def digest(column: Column, algorithm: str = "sha256", context: str | None = None) -> Column:
    """Lower-case hex digest of a string or binary column. ``context`` makes BLAKE3 a derived key; others ignore it."""
    name = _name(algorithm)
    if name != "blake3":
        return _REGISTERED[name][0](column.cast("binary"))

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        known = values.notna()
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        out[known] = [d.hex() for d in blake3(values[known], context)]
        return out

    return of(column.cast("binary"))


def digest_stream(pieces: Iterable[bytes], algorithm: str = "sha256", context: str | None = None) -> str:
    """The same digest of a file read in pieces."""
    name = _name(algorithm)
    if name == "blake3":
        return blake3_stream(pieces, context).hex()
    hasher = _REGISTERED[name][1]()
    for piece in pieces:
        hasher.update(piece)
    return hasher.hexdigest()


def digests_of(items: Iterable[T], pieces: Callable[[T], Iterable[bytes]], algorithm: str = "sha256", context: str | None = None) -> Iterator[tuple[T, str]]:
    """(item, digest of its pieces) for each item, not in order: small BLAKE3 inputs share their numpy operations."""
    if _name(algorithm) != "blake3":
        yield from ((item, digest_stream(pieces(item), algorithm, context)) for item in items)
        return
    held: list[tuple[T, bytes]] = []
    size = 0

    def together() -> Iterator[tuple[T, str]]:
        yield from zip([item for item, _ in held], (d.hex() for d in blake3([data for _, data in held], context)))
        held.clear()

    for item in items:
        rest, data = iter(pieces(item)), bytearray()
        for piece in rest:
            data += piece
            if len(data) > SMALL:
                break
        if len(data) > SMALL:
            yield item, blake3_stream(chain([bytes(data)], rest), context).hex()
            continue
        held.append((item, bytes(data)))
        size += len(data)
        if size >= TOGETHER or len(held) >= MOST:
            yield from together()
            size = 0
    yield from together()


def digest_bytes(data: bytes, algorithm: str = "sha256", context: str | None = None) -> str:
    return digest_stream([data], algorithm, context)
