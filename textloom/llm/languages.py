"""Languages of documents and of their one-language segments (problem 5).

Multinomial naive Bayes over hashed character n-grams of words.  It is fitted
on a bounded sample of labelled rows; its log-probability matrix (2**bits x
languages) is broadcast, and batches are scored in numpy: each new word once,
then sums of word scores by sentence.  Runs of sentences in one language come
from the best path over the sentences, at a price for each change.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.langlabels import LANGUAGES, language_code
from textloom.functions.tokenarrays import TokenBatch, mix64

_U = np.uint64
_BOUNDARY = re.compile("(?:[.!?…;][\"”»’')\\]]*[\\s ]+(?=[^\\s ])|\n+|\0)")
_WORD_PARTS = "doc long, lang int, data binary"


@dataclass(frozen=True)
class LanguageSpec:
    """per_language: labelled texts a language that the fit uses at most (about; by hash of the key).

    bits: hashed n-grams.  orders: lengths of the n-grams of a padded word.
    clip: nats by which one word can speak against a language, so that a
    name or two of foreign form (a place and date, a credit) make no segment.  change: nats
    that a change of language between sentences costs.  rounds: fits; each
    after the first leaves out texts whose label the last one contradicts.
    """

    per_language: int = 3000
    bits: int = 16
    orders: tuple[int, ...] = (1, 2, 3, 4)
    smoothing: float = 0.2
    clip: float = 4.5
    change: float = 14.0
    rounds: int = 2
    languages: tuple[str, ...] = field(default=LANGUAGES)


def ngram_buckets(words: list[str], spec: LanguageSpec) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word index) of all n-grams of the words, with an edge mark on either side."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    buckets, at = [], []
    for n in spec.orders:
        m = len(cps) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * _U(0x100000001B3) + cps[j : j + m] + _U(1)
        ok = owner[:m] == owner[n - 1 :]
        if n == 1:
            ok &= cps[:m] > 3
        buckets.append((mix64(h[ok]) >> _U(64 - spec.bits)).astype(np.int64))
        at.append(owner[:m][ok])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(at)


class WordScores:
    """Scores of words by language; each word of a worker is scored once."""

    MOST = 2_000_000

    def __init__(self, matrix: np.ndarray, spec: LanguageSpec) -> None:
        self.matrix, self.spec = matrix, spec
        self.hashes = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, matrix.shape[1]), np.float32)

    def of(self, batch: TokenBatch) -> np.ndarray:
        unique, first, back = np.unique(batch.hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            bucket, owner = ngram_buckets([batch.token(i) for i in first[new].tolist()], self.spec)
            rows = np.zeros((len(new), self.matrix.shape[1]), np.float64)
            for k in range(rows.shape[1]):
                rows[:, k] = np.bincount(owner, self.matrix[bucket, k], len(new))
            rows = np.maximum(rows - rows.max(axis=1, keepdims=True), -self.spec.clip).astype(np.float32)
            rows[[batch.token(i)[0].isnumeric() for i in first[new].tolist()]] = 0  # numbers speak for no language
            hashes, rows = np.concatenate([self.hashes, unique[new]]), np.concatenate([self.rows, rows])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.rows = hashes[order], rows[order]
            at = np.searchsorted(self.hashes, unique)
        out = self.rows[at][back]
        if len(self.hashes) > self.MOST:  # a cache, not a model: start again
            self.hashes, self.rows = self.hashes[:0], self.rows[:0]
        return out


def best_path(scores: np.ndarray, change: float) -> np.ndarray:
    """The language of each sentence on the best path."""
    n, m = scores.shape
    back, total = np.zeros((n, m), np.int64), scores[0].astype(float)
    for i in range(1, n):
        jump = int(total.argmax())
        stay = total >= total[jump] - change
        back[i] = np.where(stay, np.arange(m), jump)
        total = np.where(stay, total, total[jump] - change) + scores[i]
    path = np.zeros(n, np.int64)
    path[-1] = int(total.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _segments(batch: TokenBatch, words: np.ndarray, spec: LanguageSpec):
    """Per text: a list of (language index, sentences, words, score by language)."""
    ends = np.fromiter((m.start() for m in _BOUNDARY.finditer(batch.joined)), np.int64)
    cut = np.searchsorted(batch.starts, ends)  # tokens before each boundary
    cut = np.unique(np.concatenate([[0], cut]))
    if cut[-1] != len(batch.starts):
        cut = np.append(cut, len(batch.starts))
    starts = cut[:-1]
    if not len(batch.starts):
        return [[] for _ in range(len(batch))]
    sums = np.add.reduceat(words, starts, axis=0)
    size = np.diff(cut)
    first = np.searchsorted(starts, batch.offsets)
    top = sums.argmax(axis=1)
    out = []
    for i in range(len(batch)):
        a, b = int(first[i]), int(first[i + 1])
        if a == b:
            out.append([])
            continue
        if (top[a:b] == top[a]).all():
            out.append([(int(top[a]), b - a, int(size[a:b].sum()), sums[a:b].sum(axis=0))])
            continue
        path = best_path(sums[a:b], spec.change)
        edge = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), b - a]
        out.append([(int(path[s]), e - s, int(size[a + s : a + e].sum()), sums[a + s : a + e].sum(axis=0)) for s, e in zip(edge[:-1], edge[1:])])
    return out


def _count_stage(spec: LanguageSpec, shared):
    def run(batches):
        total = np.zeros((len(spec.languages), 1 << spec.bits), np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                part = whole.slice(lo, 1000)
                batch = TokenBatch(part.column("text").to_pylist())
                label = part.column("lang").to_numpy(zero_copy_only=False).astype(np.int64)
                keep = np.ones(len(batch), bool)
                if shared is not None:
                    scores = WordScores(shared.value, spec)
                    for i, seg in enumerate(_segments(batch, scores.of(batch), spec)):
                        keep[i] = len(seg) == 1 and seg[0][0] == label[i]
                unique, first, back = np.unique(batch.hashes, return_index=True, return_inverse=True)
                if not len(unique):
                    continue
                bucket, owner = ngram_buckets([batch.token(i) for i in first.tolist()], spec)
                text = np.repeat(np.arange(len(batch)), batch.counts())
                for k in range(len(spec.languages)):
                    mine = (label[text] == k) & keep[text]
                    times = np.bincount(back[mine], minlength=len(unique))
                    total[k] += np.bincount(bucket, times[owner], 1 << spec.bits).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(total)), pa.int32()), "data": pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in total], pa.binary())})

    return run


def fit_languages(samples: DataFrame, key: str = "id", text: str = "text", label: str = "language", spec: LanguageSpec = LanguageSpec()) -> np.ndarray:
    """The log-probability matrix (2**bits, languages) from labelled rows.

    To the driver come one count a language (of all rows) and, per round, a
    matrix of fixed size.  A language without labelled rows gets the flat
    probabilities of smoothing alone.
    """
    rows = samples.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), language_code(F.col(label)).alias("lang"))
    rows = rows.where("lang is not null")
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    rate, index = F.lit(None).cast("double"), F.lit(None).cast("int")
    for k, code in enumerate(spec.languages):
        rate = F.when(F.col("lang") == code, F.lit(min(1.0, spec.per_language / n.get(code, 1)))).otherwise(rate)
        index = F.when(F.col("lang") == code, F.lit(k)).otherwise(index)
    # the hash decides, so that the sample is the same on every run and place
    picked = rows.where(F.pmod(F.xxhash64(F.lit("languages"), "key"), F.lit(1_000_000)) < rate * 1_000_000).select("text", index.alias("lang"))
    shared, matrix = None, np.zeros((1 << spec.bits, len(spec.languages)), np.float32)
    for _ in range(spec.rounds):
        counts = np.zeros((len(spec.languages), 1 << spec.bits), np.int64)
        for r in picked.mapInArrow(_count_stage(spec, shared), "k int, data binary").coalesce(16).mapInArrow(_sum_stage(spec), "k int, data binary").toLocalIterator():
            counts[r.k] += np.frombuffer(pa.decompress(r.data, decompressed_size=8 << spec.bits, codec="zstd", asbytes=True), np.int64)
        smooth = counts + spec.smoothing
        matrix = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32))
        shared = samples.sparkSession.sparkContext.broadcast(matrix)
    return matrix


def _sum_stage(spec: LanguageSpec):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("k").to_pylist(), b.column("data")):
                v = np.frombuffer(pa.decompress(x.as_py(), decompressed_size=8 << spec.bits, codec="zstd", asbytes=True), np.int64)
                total[k] = total[k] + v if k in total else v
        if total:
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(total), pa.int32()), "data": pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in total.values()], pa.binary())})

    return run


def _confidence(score: np.ndarray, words: int, orders: int) -> float:
    """Posterior of the best language; n-grams overlap, so that the evidence counts once an order."""
    x = np.sort(score)[::-1] / orders
    return float(1 / np.exp(x - x[0]).sum())


def _score_stage(shared, spec: LanguageSpec, key_type: pa.DataType):
    def run(batches):
        scores = WordScores(shared.value, spec)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                part = whole.slice(lo, 2000)
                batch = TokenBatch(part.column("text").to_pylist())
                at, no, lang, sentences, words, conf, of = [], [], [], [], [], [], []
                for i, segs in enumerate(_segments(batch, scores.of(batch), spec)):
                    for s, (k, n, w, score) in enumerate(segs):
                        at.append(i)
                        no.append(s + 1)
                        lang.append(spec.languages[k])
                        sentences.append(n)
                        words.append(w)
                        conf.append(_confidence(score, w, len(spec.orders)))
                        of.append(len(segs))
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_pydict({"key": part.column("key").take(take), "code": part.column("code").take(take), "seg_no": pa.array(no, pa.int32()), "lang": pa.array(lang, pa.string()), "n_sentences": pa.array(sentences, pa.int32()), "n_tokens": pa.array(words, pa.int32()), "confidence": pa.array(conf, pa.float64()), "n_segments": pa.array(of, pa.int32())})

    return run


def language_segments(samples: DataFrame, key: str = "id", text: str = "text", label: str = "language", spec: LanguageSpec = LanguageSpec(), matrix: np.ndarray | None = None) -> DataFrame:
    """Every one-language segment of every text.

    Columns: key, code (the language the label spells, null for none), seg_no
    from 1, lang, n_sentences, n_tokens, confidence, n_segments.  Null texts
    and keys and texts without letters or numbers have no segments; a row
    delivered twice gives the same rows twice.
    """
    if matrix is None:
        matrix = fit_languages(samples, key, text, label, spec)
    shared = samples.sparkSession.sparkContext.broadcast(matrix)
    kind = dict(samples.dtypes)[key]
    rows = samples.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), language_code(F.col(label)).alias("code"), F.col(text).alias("text"))
    return rows.mapInArrow(_score_stage(shared, spec, None), f"key {kind}, code string, seg_no int, lang string, n_sentences int, n_tokens int, confidence double, n_segments int")


def mislabelled_segments(samples: DataFrame, spec: LanguageSpec = LanguageSpec()) -> DataFrame:
    """(id, seg_no, lang) of texts that hold several languages or whose label does not spell theirs."""
    rows = language_segments(samples, spec=spec).where("n_segments > 1 or code is null or code <> lang")
    return rows.select(F.col("key").alias("id"), "seg_no", "lang").distinct()


def document_languages(samples: DataFrame, spec: LanguageSpec = LanguageSpec()) -> DataFrame:
    """One row a sample: main language (of most tokens), confidence, languages held, and whether the label spells the main one."""
    rows = language_segments(samples, spec=spec).dropDuplicates(["key", "seg_no"])
    per = rows.groupBy("key", "lang").agg(F.first("code").alias("code"), F.sum("n_tokens").alias("n"), (F.sum(F.col("confidence") * F.col("n_tokens")) / F.sum("n_tokens")).alias("confidence"))
    out = per.groupBy("key").agg(F.first("code").alias("code"), F.max_by(F.struct("lang", "confidence"), F.struct("n", "lang")).alias("m"), F.count("*").alias("n_languages"))
    return out.select(F.col("key").alias("id"), F.col("m.lang").alias("lang"), F.round("m.confidence", 6).alias("confidence"), "n_languages", F.coalesce(F.col("code") == F.col("m.lang"), F.lit(False)).alias("label_right"))
