"""What a list entry says of its text, in files of the shared folder.

The task that lists texts writes one file of them, named by its attempt, and
its entries name a text by attempt and row.  A row has the text's two hashes,
size, role and the parity of its windows: bit i tells whether an odd number of
windows falls on i.  Two sets differ in at least as many windows as their
parities have different bits, so that most pairs of a common window are known
to be too different without their texts.  The files are mapped, not read.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession

from textloom.operators.postings import local_folder

_U = np.uint64
#: Pairs compared at once.
PAIRS = 200_000


def new_folder(spark: SparkSession) -> str | None:
    """A folder for such files, deleted when the session's process ends; None where the shared folder is no folder of the file system."""
    if (shared := local_folder(spark)) is None:
        return None
    path = f"{shared}/textloom-texts-{uuid.uuid4().hex}"
    os.makedirs(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"file://{path}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def words(size: np.ndarray) -> np.ndarray:
    """Words of 64 bits of a set's parity: a power of two, at least two bits a window."""
    return (1 << np.ceil(np.log2(np.maximum(1, np.asarray(size) / 32))).astype(np.int64)).astype(np.int64)


def parities(key: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parities of all sets, one after the other; key: a number of each window, text: whose it is."""
    n = words(size)
    start = np.cumsum(n) - n
    at = start[text] * 64 + (key & (n[text] * 64 - 1).astype(_U)).astype(np.int64)
    odd = np.bincount(at, minlength=int(n.sum()) * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


class Writer:
    """Numbers the texts of one task and keeps what goes into its file."""

    def __init__(self, folder: str) -> None:
        context = TaskContext.get()
        self.folder, self.attempt, self.n, self.parts = folder, context.taskAttemptId() if context else 0, 0, []

    def add(self, sig: np.ndarray, check: np.ndarray, size: np.ndarray, role: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The texts' names."""
        self.parts.append((sig, check, size, role, bits))
        name = (self.attempt << 32) + self.n + np.arange(len(sig), dtype=np.int64)
        self.n += len(sig)
        return name

    def close(self) -> None:
        if not self.n:
            return
        sig, check, size, role, bits = (np.concatenate(x) for x in zip(*self.parts))
        temporary = f"{self.folder}/{uuid.uuid4().hex}"
        with open(temporary, "wb") as out:
            for x, kind in ((np.array([len(sig), len(bits)]), "<i8"), (sig, "<i8"), (check, "<i8"), (bits, "<u8"), (np.cumsum(words(size)) - words(size), "<u4"), (size, "<u4"), (role, np.uint8)):
                x.astype(kind).tofile(out)
        os.replace(temporary, f"{self.folder}/{self.attempt}")


@dataclass
class Texts:
    """The files of one folder."""

    folder: str
    opened: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)

    def _open(self, attempt: int) -> tuple[np.ndarray, ...]:
        if attempt not in self.opened:
            path = f"{self.folder}/{attempt}"
            n, m = np.fromfile(path, "<i8", 2).tolist()
            mapped, at, out = np.memmap(path, np.uint8, "r"), 16, []
            for count, kind in ((n, "<i8"), (n, "<i8"), (m, "<u8"), (n, "<u4"), (n, "<u4"), (n, "u1")):
                upto = at + count * np.dtype(kind).itemsize
                out.append(mapped[at:upto].view(kind))
                at = upto
            self.opened[attempt] = tuple(out)
        return self.opened[attempt]

    def _by_file(self, doc: np.ndarray):
        """(which of the names, their file, their rows in it)"""
        order = np.argsort(doc, kind="stable")
        attempt = doc[order] >> 32
        edge = np.flatnonzero(np.diff(attempt, prepend=-1, append=-1))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            mine = order[lo:hi]
            yield mine, self._open(int(attempt[lo])), doc[mine] & 0xFFFFFFFF

    def about(self, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(sig, check, size, role) of each name."""
        out = tuple(np.zeros(len(doc), kind) for kind in (np.int64, np.int64, np.int64, np.uint8))
        for mine, (sig, check, _, _, size, role), row in self._by_file(doc):
            for x, known in zip(out, (sig, check, size, role)):
                x[mine] = known[row]
        return out

    def _bits(self, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parities of the names, one after the other, and where each begins; n: their words."""
        start = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.uint64)
        for mine, (_, _, bits, at, _, _), row in self._by_file(doc):
            m = n[mine]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            out[np.repeat(start[mine], m) + step] = bits[np.repeat(at[row].astype(np.int64), m) + step]
        return out, start

    def apart(self, doc: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Windows that are in one of two sets only, at least; a and b: which of the names."""
        out = np.zeros(len(a), np.int64)
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        n = words(size[used])
        bits, start = self._bits(doc[used], n)
        a, b = at[: len(a)], at[len(a) :]
        kind = n[a] * (1 << 32) + n[b]
        order = np.argsort(kind, kind="stable")
        edge = np.flatnonzero(np.diff(kind[order], prepend=-1, append=-1))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            k, m = int(n[a[order[lo]]]), int(n[b[order[lo]]])
            least, step = min(k, m), max(1, PAIRS * 8 // max(k, m))
            for i in range(lo, hi, step):
                mine = order[i : min(hi, i + step)]
                # a parity folds to half its bits by the exclusive or of its halves
                x, y = (np.bitwise_xor.reduce(bits[start[w][:, None] + np.arange(c)].reshape(len(mine), c // least, least), axis=1) if c > least else bits[start[w][:, None] + np.arange(c)] for w, c in ((a[mine], k), (b[mine], m)))
                out[mine] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out
