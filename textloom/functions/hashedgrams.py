"""Word n-grams of whole Arrow batches as 64-bit numbers, and a filter of the numbers a library has."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame

from textloom.functions.tokenarrays import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The filter has 2**BITS bits, whatever the library, in SLICES parts.
BITS, SLICES = 28, 256
ROWS = "key {}, pos int, h long"


def hashed(w: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, number) of all n-grams of a batch of word arrays."""
    lengths = w.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = w.flatten().dictionary_encode()
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = mix64(hash_array(np.array(words.dictionary.to_pylist(), dtype=object), categorize=False))[words.indices.to_numpy(zero_copy_only=False)]
    text = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    m = len(value) - n + 1
    acc = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            acc = acc * _BASE + value[j : j + m]
    whole = text[:m] == text[n - 1 :]
    return text[:m][whole], pos[:m][whole], mix64(acc[whole])


def _stage(n: int, known, named: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, pos, h = hashed(b.column("w"), n)
            if known is not None:
                bit = h >> np.uint64(64 - BITS)
                keep = known.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1
                text, pos, h = text[keep], pos[keep], h[keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64))], [named, "pos", "h"])

    return run


def grams(words: DataFrame, n: int, known=None) -> DataFrame:
    """(key, pos, h): n-grams of (key, w) by position from 0.

    known: a broadcast filter; only what may be in it is given.
    """
    kind = words.schema["key"].dataType.simpleString()
    return words.select("key", "w").mapInArrow(_stage(n, known, "key"), ROWS.format(kind))


def _bits_stage(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.unique(hashed(b.column("w"), n)[2] >> np.uint64(64 - BITS)).astype(np.uint32)
            cuts = np.searchsorted(bits, np.arange(SLICES + 1, dtype=np.uint64) * (2**BITS // SLICES))
            parts = [(k, bits[i:j].tobytes()) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["part", "bits"])

    return run


def _part_stage(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = 2**BITS // SLICES
    on = np.zeros(width, np.uint8)
    for b in batches:
        for x in b.column("bits").to_pylist():
            on[np.frombuffer(x, np.uint32) - np.uint32(key[0].as_py() * width)] = 1
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])


def known(words: DataFrame, n: int):
    """A broadcast filter of the n-grams of (key, w): 2**BITS bits, put together on the executors.

    It lets some others pass, more of them the larger the library; what passes
    has to meet the library itself.
    """
    parts = words.select("w").mapInArrow(_bits_stage(n), "part int, bits binary").groupBy("part").applyInArrow(_part_stage, "part int, bits binary")
    out = np.zeros(2**BITS // 8, np.uint8)
    width = len(out) // SLICES
    for r in parts.collect():  # at most SLICES rows, 2**BITS bits in all
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return words.sparkSession.sparkContext.broadcast(out)


def printed(w: pa.ListArray, gram: int, winnow: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, h): the set of fingerprints of each text of a batch, by the first 60 bits of a gram's md5.

    The least of each run of ``winnow`` grams; of all where there are fewer;
    that of all words where there is no gram; none without words.
    """
    digests, counts = [], []
    for words in w.to_pylist():
        n = len(words or ())
        found = [md5(x.encode()).digest() for x in map(" ".join, zip(*(words[i:] for i in range(gram))))] if n >= gram else [md5(" ".join(words).encode()).digest()] if n else []
        digests += found
        counts.append(len(found))
    h = (np.frombuffer(b"".join(digests), ">u8")[::2] >> np.uint64(4)).astype(np.uint64)
    counts = np.array(counts, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    few = np.flatnonzero((counts > 0) & (counts < winnow))
    m = max(0, len(h) - winnow + 1)
    least = h[:m]
    for j in range(1, winnow):
        least = np.minimum(least, h[j : j + m])
    whole = text[:m] == text[winnow - 1 :][:m]
    starts = (np.cumsum(counts) - counts)[few]
    shortest = np.array([h[a : a + c].min() for a, c in zip(starts, counts[few])], np.uint64)
    text, h = np.concatenate([text[:m][whole], few]), np.concatenate([least[whole], shortest])
    for _ in range(2):  # neighbours mostly have the same
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        text, h = text[new], h[new]
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
    return text, h


def prints(words: DataFrame, gram: int, winnow: int) -> DataFrame:
    """(key, pos, h): fingerprints of (key, w), at position 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, h = printed(b.column("w"), gram, winnow)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(np.zeros(len(h), np.int32)), pa.array(h.astype(np.int64))], ["key", "pos", "h"])

    return words.select("key", "w").mapInArrow(run, ROWS.format(words.schema["key"].dataType.simpleString()))
