"""Vectorised tokens and token windows for Arrow batches.

A *token* is a longest run of Unicode letters and numbers in the lower-cased
text; everything else separates.  The functions here work on a whole batch of
texts at once: one array of code points, one array of token hashes, one array
of window hashes.  They run inside ``mapInArrow`` stages, where Spark has no
built-in that hashes every window of a text without an interpreted lambda per
window.

All hashes are polynomials over 64-bit words and depend on nothing but the
characters, so that any executor, run or machine gives the same value.
"""

from __future__ import annotations

import unicodedata

import numpy as np

_LOW = 0x3000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _S30)) * _M1
        x = (x ^ (x >> _S27)) * _M2
        return x ^ (x >> _S31)


def _is_token_char(cp: int) -> bool:
    return unicodedata.category(chr(cp))[0] in "LN"


class _Tables:
    low: np.ndarray | None = None
    char: np.ndarray | None = None
    power: np.ndarray = np.ones(1, np.uint64)
    inverse: np.ndarray = np.ones(1, np.uint64)


def _low_table() -> np.ndarray:
    if _Tables.low is None:
        _Tables.low = np.array([_is_token_char(i) for i in range(_LOW)], dtype=bool)
        _Tables.char = mix64(np.arange(_LOW, dtype=np.uint64) + np.uint64(0x1234567))
    return _Tables.low


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Tables.power) < n:
        n = max(n, 1 << 16)
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _Tables.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
            _Tables.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inv, np.uint64)]), dtype=np.uint64)
    return _Tables.power, _Tables.inverse


def token_chars(cps: np.ndarray) -> np.ndarray:
    """True where a code point is a letter or a number."""
    low = _low_table()
    out = low[np.minimum(cps, _LOW - 1)]
    high = np.flatnonzero(cps >= _LOW)
    if len(high):
        values, back = np.unique(cps[high], return_inverse=True)
        out[high] = np.array([_is_token_char(int(v)) for v in values], dtype=bool)[back]
    return out


class TokenBatch:
    """Tokens of a batch of texts.

    ``starts``/``ends``: character positions in the joined lower-cased batch.
    ``hashes``: one 64-bit hash a token.  ``offsets``: text i owns the tokens
    ``offsets[i]:offsets[i + 1]``.  A null text has no tokens.
    """

    __slots__ = ("joined", "starts", "ends", "hashes", "offsets", "text_starts")

    def __init__(self, texts: list[str | None]) -> None:
        low = [(t or "").lower() for t in texts]
        lengths = np.fromiter((len(t) for t in low), np.int64, len(low))
        self.joined = "\0".join(low) + "\0"
        cps = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.text_starts = np.zeros(len(low) + 1, np.int64)
        np.cumsum(lengths + 1, out=self.text_starts[1:])
        inside = token_chars(cps)
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        self.offsets = np.searchsorted(self.starts, self.text_starts)
        power, inverse = _powers(len(cps) + 1)
        table = _Tables.char
        value = table[np.minimum(cps, _LOW - 1)].copy()
        high = np.flatnonzero(cps >= _LOW)
        if len(high):
            value[high] = mix64(cps[high].astype(np.uint64) + np.uint64(0x1234567))
        with np.errstate(over="ignore"):
            value *= power[: len(cps)]
            total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
            self.hashes = mix64((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def token(self, i: int) -> str:
        return self.joined[self.starts[i] : self.ends[i]]


def window_hashes(batch: TokenBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` tokens and the text each lies in."""
    return masked_hashes(batch, (1,) * width)


def masked_hashes(batch: TokenBatch, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows under a mask: positions with 0 do not count.

    Windows never cross two texts.  Returns (hashes, text index); window k of a
    text starts at its token k.
    """
    h, width = batch.hashes, len(mask)
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - width + 1
    acc = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, keep in enumerate(mask):
            if keep:
                acc = acc * _BASE + h[j : j + n]
            else:
                acc = acc * _BASE
    text = np.repeat(np.arange(len(batch)), batch.counts())
    whole = text[:n] == text[width - 1 :]
    return mix64(acc[whole]), text[:n][whole]


def distinct_windows(batch: TokenBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of window hashes of each text, as (hashes, offsets).

    Within a text the hashes are sorted.  A text under ``width`` tokens has an
    empty set.
    """
    h, text = window_hashes(batch, width)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[keep], text[keep]
    return h, np.searchsorted(text, np.arange(len(batch) + 1))
