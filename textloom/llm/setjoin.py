"""Exact set-similarity self-join of texts over word windows, without all pairs.

Size-aware heavy-light join.  Every text is the set of its windows of ``width``
tokens.  Windows get one global order, rare ones first; a pair of similarity t
or more then shares windows near the front of both sets:

* *light* (small) sets list fixed-size subsets (pairs of windows) of their
  front part; two light sets are compared where a whole subset agrees;
* *heavy* (large) sets scan the inverted lists of the single windows of their
  front part.  Light sets large enough to reach a heavy one are on these lists
  too, and light-light pairs are skipped there.

The size at which sets become heavy is chosen by cost from the corpus's own
size histogram and mean list length.  Nothing is approximate: the order only
decides how long lists are, the fronts follow from the threshold, and every
candidate is verified on the texts.

What is kept small: texts that are equal are one class from the start, and the
inverted lists travel as packed blocks, some seven bytes a window: an entry
names its text by task and row, and what is said of a text is looked up where
lists meet (``textfiles``).  There pairs are cut to those whose windows'
parities leave the threshold within reach, so that texts travel for few pairs
beyond the similar ones.  Where the shared folder is no folder of the file
system, entries say all of their texts and no pair is cut.  Lists meet in
two rounds.  In the first, every list up to ``split`` entries meets where it
lies; a longer one is handed on with its true length, cut into blocks, and its
blocks meet in separate tasks of the second round.  Only such lists are
replicated, whatever the counters that order the windows say; windows whose
counter stands out by more than a task's share are spread over several tasks
in the first round already.
"""

from __future__ import annotations

import math
import shutil
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.tokenarrays import TokenBatch, mix64, window_hashes
from textloom.llm.textfiles import Texts, Writer, new_folder, parities
from textloom.session import materialize, settle

#: docs: the texts' names in their files, else sigs, with sizes and roles.
_LIST = "bucket int, subset boolean, docs binary, sizes binary, roles binary, counts binary, low binary, rank binary, side binary"
_U = np.uint64


@dataclass(frozen=True)
class JoinSpec:
    """Parameters of the join.

    width, threshold: windows of so many tokens, least shared / in either.
    sketch_bits: the window counts that order the windows are kept in
    2**sketch_bits counters (8 MB at 23); a fixed size, whatever the corpus.
    split: entries beyond which a list is cut into blocks.
    per_bucket: list entries that one task handles at a time.
    fan_in: partial counts that one merge reads at a time.
    largest_subset_set: sets above this size are never light.
    """

    width: int = 5
    threshold: float = 0.5
    sketch_bits: int = 23
    split: int = 4000
    per_bucket: int = 600_000
    fan_in: int = 256
    largest_subset_set: int = 48

    def least_overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Windows that sets of sizes a and b share at least, at the threshold."""
        t = self.threshold
        return np.ceil((np.asarray(a, float) + b) * t / (1 + t) - 1e-9).astype(np.int64)

    def front(self, size: np.ndarray, subset: int) -> np.ndarray:
        """Length of the front part in which a set shares ``subset`` windows with any partner."""
        smallest = np.ceil(np.asarray(size) * self.threshold - 1e-9)
        return np.minimum(size, np.maximum(0, size - np.maximum(self.least_overlap(size, smallest), subset) + subset)).astype(np.int64)


def _task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


# --- pass 1: window counts and sizes over all texts -------------------------


def _count_stage(spec: JoinSpec):
    chunk_bits = max(0, spec.sketch_bits - 17)

    def run(batches):
        found, sizes = [], np.zeros(0, np.int64)
        for batch in _texts(batches):
            h, text = window_hashes(TokenBatch(batch.column("text").to_pylist()), spec.width)
            found.append((h >> _U(64 - spec.sketch_bits)).astype(np.uint32))
            n = np.bincount(np.bincount(text, minlength=batch.num_rows))
            if len(n) > len(sizes):
                n[: len(sizes)] += sizes
                sizes = n
            else:
                sizes[: len(n)] += n
        at = np.concatenate(found) if found else np.zeros(0, np.uint32)
        if len(at):
            parts = np.bincount(at, minlength=1 << spec.sketch_bits).astype("<u4").reshape(1 << chunk_bits, -1)
            used = [i for i in range(len(parts)) if parts[i].any()]
            yield _chunks(used, [parts[i] for i in used], _task())
        hist = np.zeros(spec.largest_subset_set * 2 + 3, "<u8")
        low = sizes[: spec.largest_subset_set * 2 + 1]
        hist[: len(low)] = low
        hist[-2:] = int((np.arange(len(sizes)) * sizes).sum()), int(sizes.sum())
        yield _chunks([-1], [hist], _task())

    return run


def _chunks(names: list[int], arrays: list[np.ndarray], task: int) -> pa.RecordBatch:
    data = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in arrays]
    return pa.RecordBatch.from_pydict({"chunk": pa.array(names, pa.int32()), "task": pa.array([task] * len(names), pa.int32()), "size": pa.array([x.nbytes for x in arrays], pa.int32()), "data": pa.array(data, pa.binary())})


_COUNTS = "chunk int, task int, size int, data binary"


def _merge_stage(last: bool):
    """Sums of partial counts; the last merge gives codes, in steps of about 9 %, so that a byte reaches beyond 10**9."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = key[0].as_py(), None
        kind = "<u4" if chunk >= 0 else "<u8"
        for b in batches:
            for x, n in zip(b.column("data"), b.column("size").to_pylist()):
                v = np.frombuffer(pa.decompress(x.as_py(), decompressed_size=n, codec="zstd", asbytes=True), kind)
                total = v.astype(np.uint64) if total is None else total + v
        if chunk >= 0:
            total = np.minimum(255, np.round(np.log2(1.0 + total) * 8)).astype(np.uint8) if last else np.minimum(total, (1 << 32) - 1).astype("<u4")
        yield _chunks([chunk], [total], key[1].as_py() if len(key) > 1 else 0)

    return run


@dataclass(frozen=True)
class Order:
    """codes: logarithms of the window counters.  light: largest light set.
    buckets: groups of lists.  noise: mean of the counters, what any window's counter has besides its own count."""

    codes: np.ndarray
    light: int
    buckets: int
    noise: float = 0.0


def corpus_order(docs: DataFrame, spec: JoinSpec) -> Order:
    """The global order of windows, the light-heavy boundary and the number of buckets.

    To the driver come the counters (a fixed 2**sketch_bits bytes), a
    histogram of the small sizes and two sums.  Partial counts are merged
    ``fan_in`` at a time before.
    """
    counts = docs.select("text").mapInArrow(_count_stage(spec), _COUNTS)
    merged = counts.withColumn("task", (F.col("task") / spec.fan_in).cast("int")).groupBy("chunk", "task").applyInArrow(_merge_stage(False), _COUNTS)
    rows = merged.groupBy("chunk").applyInArrow(_merge_stage(True), _COUNTS).collect()
    codes = np.zeros(1 << spec.sketch_bits, np.uint8)
    width = 1 << min(17, spec.sketch_bits)
    hist, windows = np.zeros(spec.largest_subset_set * 2 + 1, np.int64), 0
    for r in rows:
        data = pa.decompress(r.data, decompressed_size=r.size, codec="zstd", asbytes=True)
        if r.chunk >= 0:
            codes[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(data, np.uint8)
        else:
            told = np.frombuffer(data, "<u8").astype(np.int64)
            hist, windows = told[:-2], int(told[-2])
    # the fronts hold the rarer half of the windows: their mean list length is that of the rarer counters
    used = np.sort(codes[codes > 0])
    mean_list = float(np.mean(2.0 ** (used[: max(1, len(used) // 2)] / 8.0) - 1)) if len(used) else 0.0
    return Order(codes, light_boundary(hist, mean_list, spec), max(12, math.ceil(windows / 2 / spec.per_bucket)), windows / len(codes))


def standing_out(order: Order, spec: JoinSpec) -> np.ndarray:
    """By counter code: the entries a list has beyond the counters' mean, where they are more than one task's share; else 0.

    A full sketch makes no window stand out: what all counters have is no
    window's own.
    """
    own = 2.0 ** (np.arange(256) / 8.0) - 1 - order.noise
    return np.where(own > spec.per_bucket, own, 0.0)


def light_boundary(hist: np.ndarray, mean_list: float, spec: JoinSpec) -> int:
    """The set size up to which sets are light, at the least estimated cost.

    A light set costs its subsets; a heavy one its front and the entries that
    the scanned lists hold.  A light set of more than half the boundary is
    also listed for the heavy ones.
    """
    sizes = np.arange(len(hist))
    one, two = spec.front(sizes, 1), spec.front(sizes, 2)
    subsets = two * (two - 1) / 2
    scanned = one * (1 + mean_list)
    best, at = None, 0
    for x in range(0, spec.largest_subset_set + 1):
        light = sizes <= x
        cost = (hist * np.where(light, subsets + np.where(sizes > x * spec.threshold, one, 0), scanned)).sum()
        if best is None or cost < best:
            best, at = cost, x
    return at


# --- pass 2: fronts of all sets, as packed inverted lists -------------------


def _planes(x: np.ndarray, kind: str) -> bytes:
    """All first bytes, all second ones, ...: those that hardly change go into little when they are shuffled."""
    x = np.ascontiguousarray(x, kind)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(x.T).view(kind).reshape(-1)


def _list_stage(spec: JoinSpec, light: int, buckets: int, alone: np.ndarray, shared, folder: str | None = None):
    """alone: see ``standing_out``.  folder: where the texts' files go; None: entries say all."""
    tasks = np.maximum(1, np.ceil(alone / spec.per_bucket)).astype(np.uint64)

    def run(batches):
        codes, seen = shared.value, set()
        files = Writer(folder) if folder else None
        shift = _U(64 - spec.sketch_bits)
        collected: dict[bool, list] = {False: [], True: []}
        for batch in _texts(batches):
            sig = batch.column("sig").to_numpy(zero_copy_only=False).astype(np.int64)
            role = batch.column("role").to_numpy(zero_copy_only=False).astype(np.uint8)
            fresh = np.zeros(len(sig), bool)
            check = batch.column("check").to_pylist()
            for i, k in enumerate(zip(sig.tolist(), check, role.tolist())):
                if k not in seen:
                    seen.add(k)
                    fresh[i] = True
            at = np.flatnonzero(fresh)
            if not len(at):
                continue
            texts = batch.column("text").take(pa.array(at)).to_pylist()
            sig, role = sig[at], role[at]
            check = batch.column("check").to_numpy(zero_copy_only=False).astype(np.int64)[at]
            h, text = window_hashes(TokenBatch(texts), spec.width)
            code = codes[(h >> shift).astype(np.int64)]
            key = (code.astype(np.uint64) << _U(56)) | (h & _U((1 << 56) - 1))
            edge = np.searchsorted(text, np.arange(len(at) + 1))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                key[a:b].sort()
            keep = np.ones(len(key), bool)
            keep[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            key, text = key[keep], text[keep]
            edge = np.searchsorted(text, np.arange(len(at) + 1))
            size = np.diff(edge)
            rank = np.arange(len(key)) - edge[text]
            doc = files.add(sig, check, size, role, parities(key & _U((1 << 56) - 1), text, size)) if files else sig
            singles = (rank < spec.front(size, 1)[text]) & ((size > light) | (size > light * spec.threshold))[text]
            collected[False].append(_entries(key[singles], text[singles], rank[singles], size, doc, role, tasks))
            small = np.flatnonzero((size <= light) & (size > 1))
            if light and len(small):
                collected[True].append(_subsets(key, edge, small, size, doc, role, spec))
            single = np.flatnonzero(size == 1) if light else []
            if len(single):  # a set of one window has no pair of windows; its partners have at most 1/t of them
                collected[True].append(_subsets(key, edge, single, size, doc, role, spec, alone=True))
            tiny = np.flatnonzero((size > 1) & (size <= min(light, int(1 / spec.threshold)))) if light else []
            if len(tiny):
                collected[True].append(_subsets(key, edge, tiny, size, doc, role, spec, alone=True))
        if files:
            files.close()
        for subset, parts in collected.items():
            if parts:
                yield from _packed([np.concatenate(x) for x in zip(*parts)], subset, buckets, tasks, not folder)

    return run


def _entries(key, text, rank, size, doc, role, tasks):
    """List entries. side is 0, or the counter's code for windows that stand out."""
    # the last step before the end of the front is a lower bound of the rank, in 1/256 of the size
    low_rank = np.minimum(255, rank * 256 // np.maximum(1, size[text])).astype(np.uint8)
    code = (key >> _U(56)).astype(np.uint8)
    return key, doc[text], size[text].astype(np.uint32), role[text], low_rank, np.where(tasks[code] > 1, code, 0).astype(np.uint8)


def _subsets(key, edge, which, size, doc, role, spec: JoinSpec, alone: bool = False):
    """The fixed-size subsets of the fronts of light sets (with alone: the single windows)."""
    keys, owner = [], []
    fronts = spec.front(size, 1 if alone else 2)
    for i in which.tolist():
        front = key[edge[i] : edge[i] + fronts[i]]
        if alone:
            keys.append(front ^ _U(0x5DEECE66D))
            owner.append(np.full(len(front), i))
        else:
            a, b = np.triu_indices(len(front), 1)
            keys.append(mix64(front[a] * _U(3) + mix64(front[b])) & _U((1 << 56) - 1))
            owner.append(np.full(len(a), i))
    owner = np.concatenate(owner)
    n = len(owner)
    return np.concatenate(keys), doc[owner], size[owner].astype(np.uint32), role[owner], np.zeros(n, np.uint8), np.zeros(n, np.uint8)


def _packed(columns, subset: bool, buckets: int, tasks: np.ndarray | None = None, inline: bool = True):
    """Rows of packed lists by bucket. With tasks, a window that stands out is spread over so many buckets by its texts. inline: entries say size and role."""
    key, doc, size, role, rank, side = columns
    word = mix64(key & _U((1 << 56) - 1))
    spread = mix64(doc.astype(np.uint64)) % tasks[side] if tasks is not None else _U(0)
    bucket = (((word >> _U(40)) + spread) % _U(buckets)).astype(np.int64)
    order = np.lexsort((role, doc, bucket))
    bucket, word, doc, size, role, rank, side = (x[order] for x in (bucket, word, doc, size, role, rank, side))
    first = np.ones(len(word), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1]) | (role[1:] != role[:-1])
    text = np.flatnonzero(first)
    count = np.diff(np.append(text, len(word)))
    rows: dict[str, list] = {x.split()[0]: [] for x in _LIST.split(", ")}
    for b in np.unique(bucket).tolist():
        lo, hi = np.searchsorted(bucket, (b, b + 1))
        d0, d1 = np.searchsorted(text, (lo, hi))
        at = text[d0:d1]
        said = (_planes(size[at], "<u4"), role[at].tobytes()) if inline else (b"", b"")
        for name, value in zip(rows, (b, subset, _planes(doc[at], "<i8"), *said, _planes(count[d0:d1], "<u4"), (word[lo:hi] & _U(0xFFFFFFFF)).astype("<u4").tobytes(), rank[lo:hi].tobytes(), side[lo:hi].tobytes())):
            rows[name].append(value)
    kinds = {"bucket": pa.int32(), "subset": pa.bool_()}
    yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()})


# --- the join: lists meet, bucket by bucket ---------------------------------


_MET = "sig_a long, sig_b long, subset boolean, word binary, doc binary, size binary, role binary, rank binary, blocks binary"
_HOT = {"word": "<u8", "doc": "<i8", "size": "<u4", "role": np.uint8, "rank": np.uint8, "blocks": "<u4"}


def _handed_on(columns: dict[str, np.ndarray], subset: bool, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Entries of long lists, packed, for the second round."""
    for lo in range(0, len(columns["word"]), rows):
        packed = {k: pa.array([columns[k][lo : lo + rows].astype(kind).tobytes()], pa.binary()) for k, kind in _HOT.items()}
        yield pa.RecordBatch.from_pydict({"sig_a": pa.array([None], pa.int64()), "sig_b": pa.array([None], pa.int64()), "subset": pa.array([subset]), **packed})


def _spread_stage(spec: JoinSpec, buckets: int, inline: bool):
    """The blocks of long lists, each pair of blocks a list of its own; an entry goes to as many as its list has blocks."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                word, doc, size, role, rank, blocks = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in _HOT.items())
                times = blocks.astype(np.int64)
                mine = (mix64(doc.astype(np.uint64) ^ word) % blocks.astype(np.uint64)).astype(np.int64)
                step = max(1, spec.per_bucket * 4 // int(times.max()))
                for lo in range(0, len(word), step):
                    part = slice(lo, lo + step)
                    rep = np.repeat(np.arange(len(word))[part], times[part])
                    other = np.arange(len(rep)) - np.repeat(np.cumsum(times[part]) - times[part], times[part])
                    me, i, j = mine[rep], np.minimum(mine[rep], other), np.maximum(mine[rep], other)
                    cell = mix64(word[rep] ^ mix64((i.astype(np.uint64) << _U(32)) | (j + 1).astype(np.uint64)))
                    side = np.where(i == j, 2, np.where(me == i, 0, 1)).astype(np.uint8)
                    yield from _packed((cell, doc[rep], size[rep], role[rep], rank[rep], side), bool(batch.column("subset")[k].as_py()), buckets, inline=inline)

    return run


def _meet_stage(spec: JoinSpec, light: int, alone: np.ndarray | None, folder: str | None):
    """Candidate pairs of the lists of one bucket.

    First round (with alone): lists beyond ``split``, and parts of lists that
    are spread over tasks, are handed on.  Second round (None): lists are
    pairs of blocks, and only entries of different sides of them meet.  Copies
    of a text are one entry of a list, whatever tasks they come from.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subset = key[1].as_py()
        parts: dict[str, list] = {}
        kinds = {"docs": "<i8", "sizes": "<u4", "roles": np.uint8, "counts": "<u4", "low": "<u4", "rank": np.uint8, "side": np.uint8}
        for b in batches:
            for k, kind in kinds.items():
                parts.setdefault(k, []).extend((_from_planes if k in ("docs", "sizes", "counts") else np.frombuffer)(x.as_py(), kind) for x in b.column(k))
        col = {k: np.concatenate(v) for k, v in parts.items()}
        doc, files = col["docs"], Texts(folder) if folder else None
        sigs, checks, sizes, roles = files.about(doc) if files else (doc, np.zeros(len(doc), np.int64), col["sizes"].astype(np.int64), col["roles"])
        order = np.lexsort((roles, checks, sigs))
        new = np.zeros(len(doc), np.int64)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (roles, checks, sigs)], axis=0)
        name = np.zeros(len(doc), np.int64)
        name[order] = np.cumsum(new)
        owner = np.repeat(np.arange(len(doc)), col["counts"])
        word = col["low"]
        order = np.lexsort(((sizes * len(doc) + name)[owner], word))
        word, owner, side = word[order], owner[order], col["side"][order]
        fresh = np.ones(len(word), bool)
        fresh[1:] = (word[1:] != word[:-1]) | (name[owner[1:]] != name[owner[:-1]]) | (side[1:] != side[:-1])
        order, word, owner, side = (x[fresh] for x in (order, word, owner, side))
        sig, size, role, rank = sigs[owner], sizes[owner], roles[owner], col["rank"][order]

        def reached(found: list[np.ndarray]) -> np.ndarray:
            """(sig_a, sig_b) of the pairs whose parities leave the threshold within reach."""
            a, b = np.divmod(np.unique(np.concatenate(found)), len(doc))
            if files:
                ok = sizes[a] + sizes[b] - files.apart(doc, sizes, a, b) >= 2 * spec.least_overlap(sizes[a], sizes[b])
                a, b = a[ok], b[ok]
            return _unique_pairs([np.stack([np.minimum(sigs[a], sigs[b]), np.maximum(sigs[a], sigs[b])])])

        if alone is not None:
            edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(edge, len(word)))
            entries = np.maximum(np.repeat(length, length), alone[side])
            hot = entries > spec.split
            if hot.any():
                yield from _handed_on({"word": word[hot], "doc": doc[owner[hot]], "size": size[hot], "role": role[hot], "rank": rank[hot], "blocks": np.ceil(entries[hot] / spec.split)}, subset)
                word, owner, sig, size, role, rank = (x[~hot] for x in (word, owner, sig, size, role, rank))
            side = np.full(len(word), 2, np.uint8)
        low_rank = rank.astype(np.int64) * size // 256
        alive, step, found, kept = np.arange(len(word) - 1), 1, [], []
        pending = 0
        while True:
            alive = alive[alive + step < len(word)]
            alive = alive[word[alive] == word[alive + step]]
            if not len(alive):
                break
            i, j = alive, alive + step
            ok = size[j] * spec.threshold <= size[i] + 1e-9  # beyond, later ones are larger still
            alive = alive[ok]
            i, j = i[ok], j[ok]
            ok = (sig[i] != sig[j]) & (((role[i] & 1) & (role[j] >> 1)) | ((role[j] & 1) & (role[i] >> 1))).astype(bool)
            ok &= (side[i] == 2) | (side[i] != side[j])
            if not subset:
                if light:
                    ok &= size[j] > light
                need = spec.least_overlap(size[i], size[j])
                ok &= 1 + np.minimum(size[i] - low_rank[i], size[j] - low_rank[j]) - 1 >= need
            i, j = i[ok], j[ok]
            if len(i):
                found.append(np.minimum(owner[i], owner[j]) * len(doc) + np.maximum(owner[i], owner[j]))
                pending += len(i)
            if pending > 4_000_000:
                kept.append(reached(found))
                found, pending = [], 0
                if sum(x.shape[1] for x in kept) > 1_000_000:
                    yield _pair_batch(_unique_pairs(kept))
                    kept = []
            step += 1
        if found:
            kept.append(reached(found))
        if kept:
            yield _pair_batch(_unique_pairs(kept))

    return run


def _unique_pairs(parts: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(parts, axis=1)
    order = np.lexsort((x[1], x[0]))
    x = x[:, order]
    keep = np.ones(x.shape[1], bool)
    keep[1:] = (x[:, 1:] != x[:, :-1]).any(axis=0)
    return x[:, keep]


def _pair_batch(x: np.ndarray) -> pa.RecordBatch:
    none = {c.split()[0]: pa.nulls(x.shape[1], pa.bool_() if c.endswith("boolean") else pa.binary()) for c in _MET.split(", ")[2:]}
    return pa.RecordBatch.from_pydict({"sig_a": pa.array(x[0]), "sig_b": pa.array(x[1]), **none})


def candidate_pairs(docs: DataFrame, spec: JoinSpec) -> DataFrame:
    """Class pairs (sig_a < sig_b) whose fronts meet and whose parities don't tell them apart; a superset of the similar pairs."""
    spark = docs.sparkSession
    order = corpus_order(docs, spec)
    alone = standing_out(order, spec)
    folder = new_folder(spark)
    shared = spark.sparkContext.broadcast(order.codes)  # 2**sketch_bits bytes, whatever the corpus
    settle(spark)  # what was shuffled goes as soon as it is done with, here and below
    lists = docs.select("sig", "check", "role", "text").mapInArrow(_list_stage(spec, order.light, order.buckets, alone, shared, folder), _LIST)
    met = materialize(lists.groupBy("bucket", "subset").applyInArrow(_meet_stage(spec, order.light, alone, folder), _MET), "met")
    settle(spark)
    blocks = met.where("sig_a is null").mapInArrow(_spread_stage(spec, order.buckets, not folder), _LIST)
    again = blocks.groupBy("bucket", "subset").applyInArrow(_meet_stage(spec, order.light, None, folder), _MET)
    pairs = materialize(met.where("sig_a is not null").unionByName(again).select("sig_a", "sig_b").distinct(), "candidates")
    if folder:
        shutil.rmtree(folder, ignore_errors=True)
    settle(spark)
    return pairs


# --- verification -----------------------------------------------------------


def _verify_stage(spec: JoinSpec):
    def run(batches):
        for batch in _texts(batches):
            texts = batch.column("text_a").to_pylist() + batch.column("text_b").to_pylist()
            index: dict[str, int] = {}
            at = np.array([index.setdefault(t, len(index)) for t in texts])
            h, text = window_hashes(TokenBatch(list(index)), spec.width)
            edge = np.searchsorted(text, np.arange(len(index) + 1))
            sets = [np.unique(h[a:b]) for a, b in zip(edge[:-1], edge[1:])]
            n = batch.num_rows
            rows = []
            for k in range(n):
                a, b = sets[at[k]], sets[at[k + n]]
                if not len(a) or not len(b):
                    continue
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                score = shared / (len(a) + len(b) - shared)
                if score >= spec.threshold:
                    rows.append((k, score))
            if rows:
                take = pa.array([k for k, _ in rows])
                yield pa.RecordBatch.from_pydict({**{c: batch.column(c).take(take) for c in ("sig_a", "check_a", "sig_b", "check_b")}, "similarity": pa.array([x for _, x in rows], pa.float64())})

    return run


def _filter_stage(bits: int):
    """Bits of a Bloom filter (two positions a class) of the classes in candidates."""

    def run(batches):
        word = np.zeros(1 << bits, bool)
        for b in batches:
            for c in ("sig_a", "sig_b"):
                h = mix64(b.column(c).to_numpy().astype(np.uint64))
                word[(h & _U((1 << bits) - 1)).astype(np.int64)] = True
                word[(h >> _U(64 - bits)).astype(np.int64)] = True
        yield _chunks([0], [np.packbits(word)], _task())

    return run


def _or_stage(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = None
    for b in batches:
        for x, n in zip(b.column("data"), b.column("size").to_pylist()):
            v = np.frombuffer(pa.decompress(x.as_py(), decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
            word = v if word is None else word | v
    yield _chunks([0], [word], key[0].as_py())


def class_filter(pairs: DataFrame, bits: int = 23, fan_in: int = 256) -> np.ndarray:
    """A Bloom filter of 2**bits bits (1 MB) over the classes of candidate pairs.

    It only spares texts without candidates the shuffle; the join after it is
    exact.  Its size does not grow; over a very large corpus it passes more.
    Every task makes one of its own, and they are merged ``fan_in`` at a time.
    """
    word = np.zeros((1 << bits) // 8, np.uint8)
    parts = pairs.mapInArrow(_filter_stage(bits), _COUNTS)
    for _ in range(2):
        parts = parts.withColumn("task", (F.col("task") / fan_in).cast("int")).groupBy("task").applyInArrow(_or_stage, _COUNTS)
    for r in parts.toLocalIterator():
        word |= np.frombuffer(pa.decompress(r.data, decompressed_size=len(word), codec="zstd", asbytes=True), np.uint8)
    return word


def _passing_stage(shared, bits: int):
    def run(batches):
        word, seen = np.unpackbits(shared.value).astype(bool), set()
        for b in batches:
            h = mix64(b.column("sig").to_numpy().astype(np.uint64))
            ok = word[(h & _U((1 << bits) - 1)).astype(np.int64)] & word[(h >> _U(64 - bits)).astype(np.int64)]
            at = np.flatnonzero(ok)
            # copies of a text leave a task once
            fresh = [i for i, k in zip(at.tolist(), zip(b.column("sig").take(pa.array(at)).to_pylist(), b.column("check").take(pa.array(at)).to_pylist())) if not (k in seen or seen.add(k))]
            if fresh:
                yield b.take(pa.array(fresh))

    return run


def similar_classes(docs: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """Pairs of different texts of similarity ``threshold`` or more.

    docs: sig and check long (two hashes of the text, see ``identity``), role
    tinyint (bit 1: left side, bit 2: right side; 3 for both), text.  Returns
    sig_a, check_a, sig_b, check_b (sig_a < sig_b) and similarity; one row a
    pair of classes.

    Lists know a text by sig alone, so that texts of one sig are all verified
    against its candidates; results know it by both, 128 bits.

    Null and short texts (fewer tokens than ``width``) have no windows and so
    no partners.  Repeated rows count once.  An empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    pairs = candidate_pairs(docs, spec)
    bits = 23
    shared = sc.broadcast(class_filter(pairs, bits, spec.fan_in))
    texts = docs.select("sig", "check", "text").mapInArrow(_passing_stage(shared, bits), "sig long, check long, text string").repartition("sig").dropDuplicates(["sig", "check"])
    a, b = (texts.select(*[F.col(c).alias(f"{c}_{side}") for c in ("sig", "check", "text")]) for side in "ab")
    joined = pairs.join(a, "sig_a").join(b, "sig_b")
    return joined.select("sig_a", "check_a", "sig_b", "check_b", "text_a", "text_b").mapInArrow(_verify_stage(spec), "sig_a long, check_a long, sig_b long, check_b long, similarity double")


def identity(text: str) -> list[Column]:
    """The two hashes a class of equal texts is known by."""
    return [F.xxhash64(text).alias("sig"), F.xxhash64(F.lit("check"), F.col(text)).alias("check")]
