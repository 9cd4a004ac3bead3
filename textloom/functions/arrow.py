"""What no built-in expresses, as Arrow UDFs on whole batches."""

from __future__ import annotations

import html
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def normalize_unicode(text: pd.Series) -> pd.Series:
    """HTML entities undone and characters composed (NFC); null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFC", html.unescape(t)), na_action="ignore")


@F.pandas_udf(StringType())
def compose(text: pd.Series) -> pd.Series:
    """Characters composed (NFC); null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """Mean ratio of zlib 9 over pieces of at most 1000 characters; null under 300 characters."""

    def ratio(t: str | None) -> float | None:
        if t is None or len(t) < 300:
            return None
        n = -(-len(t) // 1000)
        size = -(-len(t) // n)
        parts = [t[i : i + size].encode() for i in range(0, len(t), size)]
        return float(np.mean([len(zlib.compress(p, 9)) / len(p) for p in parts]))

    return text.map(ratio)


def _factors(words: list[str], threshold: float) -> float:
    seen: set[str] = set()
    count, factors = 0, 0.0
    for w in words:
        count += 1
        seen.add(w)
        if len(seen) / count <= threshold:
            factors, count, seen = factors + 1, 0, set()
    if count:
        factors += (1 - len(seen) / count) / (1 - threshold)
    return len(words) / factors if factors else float(len(words))


def mtld_rows(batches):
    """Arrow batches (doc_id, w) to (doc_id, voc_mtld).

    For word arrays that are themselves higher-order expressions: a UDF over
    those is not taken out of the projection.
    """
    for b in batches:
        out = [_factors_mean(w) for w in b.column("w").to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "voc_mtld": pa.array(out, pa.float64())})


def _factors_mean(w) -> float | None:
    if w is None or len(w) < 50:
        return None
    w = list(w)
    return (_factors(w, 0.72) + _factors(w[::-1], 0.72)) / 2


@F.pandas_udf(DoubleType())
def mtld(words: pd.Series) -> pd.Series:
    """Lexical diversity: mean of the forward and the backward pass, threshold 0.72; null under fifty words."""

    return words.map(_factors_mean)


@F.pandas_udf(DoubleType())
def top_eigen_share(gram: pd.Series) -> pd.Series:
    """Share of the largest eigenvalue of a centred square matrix given as rows; null under three rows."""

    def value(k) -> float | None:
        if k is None or len(k) < 3:
            return None
        m = np.array([np.asarray(r, float) for r in k])
        m = m - m.mean(axis=0) - m.mean(axis=1)[:, None] + m.mean()
        e = np.clip(np.linalg.eigvalsh(m), 0, None)
        return float(e[-1] / e.sum()) if e.sum() > 1e-12 else None

    return gram.map(value)
