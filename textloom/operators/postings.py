"""A library's grams as sorted files in the shared folder, which tasks look their texts' grams up in.

Grams that many texts share meet in a number of rows that grows with the square
of the input.  Here these exist as arrays of one small batch only: no shuffle
ever holds them.  The files are mapped, not read, so that a task's memory
doesn't grow with the library.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import hashedgrams as H
from textloom.session import materialize, shared_dir

#: Texts looked up at once, and rows they may meet in; one text alone may meet more.
TEXTS, MET = 2000, 2_000_000


@dataclass(frozen=True)
class Index:
    folder: str
    buckets: int
    n_refs: int

    def open(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(h, ref, pos) of a bucket, by h."""
        if (self.folder, k) not in _OPEN:
            path = f"{self.folder}/{k}"
            n = os.path.getsize(path) // 16 if os.path.exists(path) else 0
            at = lambda kind, start: np.memmap(path, kind, "r", start, (n,)) if n else np.zeros(0, kind)
            _OPEN[self.folder, k] = at(np.uint64, 0), at(np.uint32, 8 * n), at(np.uint32, 12 * n)
        return _OPEN[self.folder, k]

    def refs(self) -> pa.ChunkedArray:
        """The references' keys by number."""
        if self.folder not in _OPEN:
            _OPEN[self.folder] = pa.ipc.open_file(pa.memory_map(f"{os.path.dirname(self.folder)}/refs")).read_all().column(0)
        return _OPEN[self.folder]

    def spans(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, first, count) of each number's rows."""
        bucket, first, count = (h % np.uint64(self.buckets)).astype(np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        order = np.lexsort((h, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[k] : cuts[k + 1]]
            known = self.open(int(k))[0]
            first[mine] = np.searchsorted(known, h[mine])
            count[mine] = np.searchsorted(known, h[mine], "right") - first[mine]
        return bucket, first, count

    def met(self, bucket: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, ref, pos): which of the numbers, and what it meets."""
        row, ref, pos = [], [], []
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[k] : cuts[k + 1]]
            c = count[mine]
            at = np.repeat(first[mine] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            _, r, p = self.open(int(k))
            row.append(np.repeat(mine, c)), ref.append(r[at]), pos.append(p[at])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, ref, pos))


_OPEN: dict = {}


def local_folder(spark) -> str | None:
    """The shared folder where it is one of the file system, else nothing."""
    named = shared_dir(spark)
    return named.removeprefix("file://") if named.startswith(("file:///", "/")) else None


def _refs_stage(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, sink, temporary = 0, None, f"{folder}/refs-{uuid.uuid4().hex}"
        for b in batches:
            sink = sink or pa.ipc.new_file(temporary, b.schema)
            sink.write_batch(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(no, no + b.num_rows, dtype=np.int64))], ["key", "no"])
            no += b.num_rows
        if sink:
            sink.close()
            os.replace(temporary, f"{folder}/refs")

    return run


def _bucket_stage(folder: str):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(c).to_numpy() for c in ("h", "no", "pos")) for b in batches]
        h, no, pos = (np.concatenate(x) for x in zip(*parts))
        h = h.view(np.uint64)
        order = np.lexsort((pos, no, h))
        h, no, pos = h[order], no[order], pos[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (no[1:] != no[:-1]) | (pos[1:] != pos[:-1])
        h, no, pos = h[new], no[new], pos[new]
        temporary = f"{folder}/{uuid.uuid4().hex}"
        with open(temporary, "wb") as out:
            for x in (h, no.astype(np.uint32), pos.astype(np.uint32)):
                x.tofile(out)
        os.replace(temporary, f"{folder}/{key[0].as_py()}")
        yield pa.RecordBatch.from_arrays([pa.array([len(h)], pa.int64())], ["n"])

    return run


@dataclass(frozen=True)
class Numbers:
    """A library's keys by number: a folder, (key, no) and how many."""

    folder: str
    rows: DataFrame
    n: int


def number(keys: DataFrame, folder: str) -> Numbers:
    """keys: (key), each once, numbered in their order."""
    spark = keys.sparkSession
    path = f"{folder}/textloom-index-{uuid.uuid4().hex}"
    os.makedirs(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"file://{path}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    kind = keys.schema["key"].dataType.simpleString()
    rows = materialize(keys.repartition(1).sortWithinPartitions("key").mapInArrow(_refs_stage(path), f"key {kind}, no long"), "numbers")  # keys alone, one stream
    return Numbers(path, rows, rows.count())


def index(named: Numbers, rows: DataFrame) -> Index:
    """Files of (key, pos, h) rows, in as many buckets as the session shuffles into."""
    path = f"{named.folder}/{uuid.uuid4().hex}"
    os.makedirs(path)
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by the unsigned number, as the tasks take it
    bucket = F.expr(f"cast((pmod(h, {buckets}) + if(h < 0, {pow(2, 64, buckets)}, 0)) % {buckets} as int)")
    rows.join(named.rows, "key").select(bucket.alias("bucket"), "h", "no", "pos").groupBy("bucket").applyInArrow(_bucket_stage(path), "n long").agg(F.sum("n")).collect()  # one row
    return Index(path, buckets, named.n)


def _islands(t: np.ndarray, ref: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, ref, start, ref_start, grams) of runs: neighbours on a diagonal."""
    diag = pa_ - pb
    low, wide, high = diag.min(), diag.max() - diag.min() + 1, pa_.max() + 2
    n_ref = ref.max() + 1
    if float(t.max() + 1) * float(n_ref) * float(wide) * float(high) < 2**62:
        v = np.sort(((t * n_ref + ref) * wide + diag - low) * high + pa_)
        first = np.flatnonzero(np.diff(v, prepend=v[0] - 2) != 1)
        grams = np.diff(first, append=len(v))
        v, start = np.divmod(v[first], high)
        v, d = np.divmod(v, wide)
        t, ref = np.divmod(v, n_ref)
        return t, ref, start, start - (d + low), grams
    order = np.lexsort((pa_, diag, ref, t))
    t, ref, pa_, diag = t[order], ref[order], pa_[order], diag[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (ref[1:] != ref[:-1]) | (diag[1:] != diag[:-1]) | (pa_[1:] != pa_[:-1] + 1)
    first = np.flatnonzero(new)
    return t[first], ref[first], pa_[first], pa_[first] - diag[first], np.diff(first, append=len(t))


def in_parts(text: np.ndarray, count: np.ndarray) -> Iterator[slice]:
    """Slices of whole texts that meet in MET rows at most, where one text doesn't alone; text is ascending."""
    edge = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
    upto = np.concatenate([[0], np.cumsum(count)])[edge]
    i = 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + MET, "right")) - 1)
        yield slice(edge[i], edge[j])
        i = j


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(i, TEXTS) for i in range(0, b.num_rows, TEXTS))


def _runs_stage(known: Index, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            text, pos, h = H.hashed(b.column("w"), n)
            bucket, first, count = known.spans(h)
            hit = count > 0
            text, pos, bucket, first, count = (x[hit] for x in (text, pos, bucket, first, count))
            for s in in_parts(text, count):
                row, ref, pb = known.met(bucket[s], first[s], count[s])
                t, ref, start, ref_start, grams = _islands(text[s][row], ref.astype(np.int64), pos[s][row], pb.astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), _flat(known.refs().take(pa.array(ref))), pa.array(start.astype(np.int32)), pa.array(ref_start.astype(np.int32)), pa.array(grams.astype(np.int64) + n - 1)], ["key", "ref", "start", "ref_start", "length"])

    return run


def _flat(x: pa.ChunkedArray) -> pa.Array:
    return x.chunk(0) if x.num_chunks == 1 else pa.concat_arrays(x.chunks)


def runs(texts: DataFrame, library: DataFrame, folder: str, n: int) -> DataFrame:
    """(key, ref, start, ref_start, length): maximal runs of at least n equal words; texts, library: (key, w)."""
    known = index(number(library.select("key").distinct(), folder), H.grams(library, n))
    kinds = [x.schema["key"].dataType.simpleString() for x in (texts, library)]
    return texts.select("key", "w").mapInArrow(_runs_stage(known, n), "key {}, ref {}, start int, ref_start int, length long".format(*kinds))


def best_pairs(known: Index, w: pa.ListArray, gram: int, winnow: int, top: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, ref, shared, rank) of the ``top`` references of each text of a batch, by slices of whole texts."""
    text, h = H.printed(w, gram, winnow)
    bucket, first, count = known.spans(h)
    hit = count > 0
    text, bucket, first, count = (x[hit] for x in (text, bucket, first, count))
    for s in in_parts(text, count):
        row, ref, _ = known.met(bucket[s], first[s], count[s])
        base, mine = text[s][0], text[s]
        v = np.sort((mine[row] - base) * known.n_refs + ref)
        at = np.flatnonzero(np.diff(v, prepend=-1))
        shared = np.diff(at, append=len(v))
        t, ref = np.divmod(v[at], known.n_refs)
        del v, row
        # of those that share one, more than the first ``top`` of a text by reference can't be among its best
        once = np.cumsum(shared == 1)
        begins = np.flatnonzero(np.diff(t, prepend=-1))
        before = np.repeat((once - (shared == 1))[begins], np.diff(begins, append=len(t)))
        keep = (shared > 1) | (once - before <= top)
        t, ref, shared = t[keep], ref[keep], shared[keep]
        order = np.lexsort((-shared, t))  # stable: equal ones stay by reference
        t, ref, shared = t[order], ref[order], shared[order]
        begins = np.flatnonzero(np.diff(t, prepend=-1))
        rank = np.arange(len(t)) - np.repeat(begins, np.diff(begins, append=len(t))) + 1
        keep = rank <= top
        yield t[keep] + base, ref[keep], shared[keep], rank[keep]


def _best_stage(known: Index, gram: int, winnow: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            for t, ref, shared, rank in best_pairs(known, b.column("w"), gram, winnow, top):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), _flat(known.refs().take(pa.array(ref))), pa.array(shared.astype(np.int64)), pa.array(rank.astype(np.int32))], ["key", "ref", "shared", "rank"])

    return run


def best(texts: DataFrame, library: DataFrame, folder: str, gram: int, winnow: int, top: int) -> DataFrame:
    """(key, ref, shared, rank): the ``top`` references of each text by shared fingerprints; texts, library: (key, w)."""
    known = index(number(library.select("key").distinct(), folder), H.prints(library, gram, winnow))
    kinds = [x.schema["key"].dataType.simpleString() for x in (texts, library)]
    return texts.select("key", "w").mapInArrow(_best_stage(known, gram, winnow, top), "key {}, ref {}, shared long, rank int".format(*kinds))
