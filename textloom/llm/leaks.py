"""Evaluation passages inside a training corpus (problem 7).

Spaced-seed hashing: every window of twelve tokens, of evaluation items and of
documents, is hashed under fixed masks that ignore some of its positions.
Equal hashes are hits; around each hit the tokens of both texts are compared
along the diagonal, which gives the longest exact run and the longest overlap
that tolerates substitutions.  No mask is longer than the shortest run to be
found, so that every exact run of twelve tokens has a hit under each mask.

The evaluation side is a stated query set: its token hashes go to the
executors in blocks of a bounded size, each block against all documents.
Documents are read once and never shuffled; a task holds one block at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.tokenarrays import TokenBatch, masked_hashes

_U = np.uint64
#: Diagonals of a document and an item from which they are compared all at once.
MANY = 200


@dataclass(frozen=True)
class LeakSpec:
    """run: tokens in a row that make a leak.  masks: spans of at most ``run``.

    mismatch: what a substituted token costs in an overlap, in matched tokens.
    block_chars: characters of evaluation text sent to the executors at once.
    """

    run: int = 12
    masks: tuple[tuple[int, ...], ...] = ((1, 1, 1, 0, 1, 1, 0, 1, 0, 1, 1, 1), (1, 1, 0, 1, 0, 0, 1, 1, 1, 0, 1, 1))
    mismatch: int = 3
    block_chars: int = 8_000_000


class _Items:
    """A block of evaluation items: token hashes, and sorted window hashes a mask."""

    def __init__(self, ids: list, texts: list[str], spec: LeakSpec) -> None:
        batch = TokenBatch(texts)
        self.ids, self.hashes, self.offsets = ids, batch.hashes, batch.offsets
        self.seeds = []
        for mask in spec.masks:
            h, text = masked_hashes(batch, mask)
            first = np.searchsorted(text, np.arange(len(texts) + 1))
            at = np.arange(len(h)) - first[text]
            order = np.argsort(h, kind="stable")
            self.seeds.append((h[order], text[order], at[order]))
        self.gate = np.zeros(1 << 20, bool)
        for h, _, _ in self.seeds:
            self.gate[(h >> _U(44)).astype(np.int64)] = True


def _longest_true(eq: np.ndarray) -> int:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], eq.astype(np.int8), [0]])))
    return int((edge[1::2] - edge[::2]).max()) if len(edge) else 0


def _best_overlap(eq: np.ndarray, mismatch: int) -> tuple[int, int]:
    """(matched tokens, substituted ones) of the best stretch: +1 a match, -mismatch a substitution."""
    total = np.concatenate([[0], np.cumsum(np.where(eq, 1, -mismatch))])
    low = np.minimum.accumulate(total)
    gain = total - low
    end = int(gain.argmax())
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    matched = int(eq[start:end].sum())
    return matched, end - start - matched


def _overlaps(own: np.ndarray, doc: np.ndarray, shifts: np.ndarray, mismatch: int) -> tuple[int, int, int]:
    """(longest run, matched, substituted) over many diagonals at once, as the two functions above give them one by one."""
    run, longest, score, best, now, gone, matched, changed = np.zeros((8, len(shifts)), np.int64)
    for j, token in enumerate(own):
        at = shifts + j
        there = (at >= 0) & (at < len(doc))
        eq = there & (doc[np.clip(at, 0, len(doc) - 1)] == token)
        run = np.where(eq, run + 1, 0)
        longest = np.maximum(longest, run)
        score += np.where(eq, 1, np.where(there, -mismatch, 0))
        now += eq
        gone += there & ~eq
        low = score <= 0
        score[low], now[low], gone[low] = 0, 0, 0
        up = score > best
        best = np.where(up, score, best)
        matched, changed = np.where(up, now, matched), np.where(up, gone, changed)
    good = (longest >= 0) & (matched > 0)
    if not good.any():
        return 0, 0, 0
    top = np.lexsort((-changed, matched))[-1]
    return int(longest.max()), int(matched[top]), int(changed[top])


def _distinct(hits: np.ndarray) -> np.ndarray:
    """Distinct columns (document, item, shift), in order; as one number each where that fits."""
    low, high = hits.min(axis=1), hits.max(axis=1)
    size = [int(x) for x in high - low + 1]
    if size[0] * size[1] * size[2] >= 1 << 62:
        return np.unique(hits, axis=1)
    key = np.unique(((hits[0] - low[0]) * size[1] + hits[1] - low[1]) * size[2] + hits[2] - low[2])
    pair, shift = np.divmod(key, size[2])
    return np.stack([pair // size[1] + low[0], pair % size[1] + low[1], shift + low[2]])


def _gathered(batches, rows: int):
    """Batches of about ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


def _stage(blocks, key: str, spec: LeakSpec):
    """blocks: broadcast items. With several, each is read for many documents at a time and given up again."""

    def run(batches):
        for some in _gathered(batches, 1 if len(blocks) == 1 else 50_000):
            for shared in blocks:
                items: _Items = shared.value
                yield from found(some, items)
                if len(blocks) > 1:
                    vars(shared).pop("_value", None)  # read again from the executor's copy when its turn comes

    def found(batches, items: _Items):
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                tokens = TokenBatch(batch.column("text").to_pylist())
                hits = []
                for mask, (seed, item, at) in zip(spec.masks, items.seeds):
                    h, text = masked_hashes(tokens, mask)
                    near = np.flatnonzero(items.gate[(h >> _U(44)).astype(np.int64)])
                    if not len(near):
                        continue
                    first = np.searchsorted(text, np.arange(len(tokens) + 1))
                    a, b = np.searchsorted(seed, h[near], "left"), np.searchsorted(seed, h[near], "right")
                    times = b - a
                    w = np.repeat(near, times)
                    k = np.arange(len(w)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(a, times)
                    place = w - first[text[w]]
                    hits.append(np.stack([text[w], item[k], place - at[k]]))
                if not hits:
                    continue
                found = _distinct(np.concatenate(hits, axis=1))
                rows: dict[tuple[int, int], tuple[int, int, int]] = {}
                pair = np.flatnonzero(np.concatenate([[True], (found[:2, 1:] != found[:2, :-1]).any(axis=0)]))
                times = np.diff(np.append(pair, found.shape[1]))
                for k in np.flatnonzero(times > MANY):  # texts that repeat themselves
                    lo, hi = int(pair[k]), int(pair[k] + times[k])
                    d, i = int(found[0, lo]), int(found[1, lo])
                    doc = tokens.hashes[tokens.offsets[d] : tokens.offsets[d + 1]]
                    own = items.hashes[items.offsets[i] : items.offsets[i + 1]]
                    longest, matched, changed = _overlaps(own, doc, found[2, lo:hi], spec.mismatch)
                    if longest >= spec.run or matched - spec.mismatch * changed >= spec.run:
                        rows[d, i] = (longest, matched, changed)
                for d, i, shift in found[:, np.repeat(times <= MANY, times)].T.tolist():
                    doc = tokens.hashes[tokens.offsets[d] : tokens.offsets[d + 1]]
                    own = items.hashes[items.offsets[i] : items.offsets[i + 1]]
                    s, e = max(0, -shift), min(len(own), len(doc) - shift)
                    eq = own[s:e] == doc[s + shift : e + shift]
                    longest = _longest_true(eq)
                    matched, changed = _best_overlap(eq, spec.mismatch)
                    if longest < spec.run and matched - spec.mismatch * changed < spec.run:
                        continue
                    old = rows.get((d, i), (0, 0, 0))
                    best = max((matched, -changed), (old[1], -old[2]))
                    rows[d, i] = (max(longest, old[0]), best[0], -best[1])
                if rows:
                    keys = batch.column(key)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": keys.take(pa.array([d for d, _ in rows])),
                            "item_id": pa.array([items.ids[i] for _, i in rows], pa.int64()),
                            "longest_run": pa.array([v[0] for v in rows.values()], pa.int32()),
                            "matched": pa.array([v[1] for v in rows.values()], pa.int32()),
                            "substituted": pa.array([v[2] for v in rows.values()], pa.int32()),
                            "item_tokens": pa.array([int(items.offsets[i + 1] - items.offsets[i]) for _, i in rows], pa.int32()),
                        }
                    )

    return run


def leaks(documents: DataFrame, eval_items: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """Every (document, item) with a common passage.

    documents: doc_id, text; eval_items: item_id, text.  Columns: doc_id,
    item_id, longest_run (tokens in a row in common), matched and substituted
    (of the best overlap that tolerates substitutions), item_tokens.

    Null texts and ids have no rows; texts under twelve tokens can't leak;
    items with equal texts each have their rows; repeated rows of an item or a
    document count once.  An empty table gives no rows.
    """
    items = eval_items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").dropDuplicates(["item_id"])
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / spec.block_chars))
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    shared = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").collect()  # a block's share of block_chars
        shared.append(docs.sparkSession.sparkContext.broadcast(_Items([r.item_id for r in rows], [r.text for r in rows], spec)))
    return docs.mapInArrow(_stage(shared, "doc_id", spec), "doc_id long, item_id long, longest_run int, matched int, substituted int, item_tokens int").dropDuplicates(["doc_id", "item_id"])


def leaked_pairs(documents: DataFrame, eval_items: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """(doc_id, item_id) with at least ``run`` consecutive tokens in common."""
    return leaks(documents, eval_items, spec).where(F.col("longest_run") >= spec.run).select("doc_id", "item_id")


def leaked_items(documents: DataFrame, eval_items: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """One row an item: documents that hold a run of it, and the longest run."""
    found = leaks(documents, eval_items, spec).where(F.col("longest_run") >= spec.run).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("longest_run").alias("longest_run"))
    items = eval_items.where("item_id is not null").select(F.col("item_id").cast("long"), "eval_set").dropDuplicates(["item_id"])
    return items.join(found, "item_id", "left").select("item_id", "eval_set", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "longest_run")])


def changed_pairs(documents: DataFrame, eval_items: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """(doc_id, item_id, matched, substituted): passages held with substitutions only, no run of them long enough.

    Found where twelve matched tokens are left after what substitutions cost;
    a mask has to fit between the substitutions (see the README for recall).
    """
    return leaks(documents, eval_items, spec).where(F.col("longest_run") < spec.run).select("doc_id", "item_id", "matched", "substituted")
