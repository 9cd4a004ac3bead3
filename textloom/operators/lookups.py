"""What texts have in common with a library's references, pair by pair, by looking texts up in the library's files.

A pair exists where a text and a reference share a fingerprint.  Pairs grow with
the square of the input: they are arrays of one small batch only, and what comes
out of a task are the result's rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import hashedgrams as H
from textloom.operators import postings as N

#: Cells of a table of term counts, and rows taken at once.
CELLS, ROWS = 4_000_000, 1_000_000


def micro(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """k / n in millionths, halves upwards; n from 1."""
    return (2_000_000 * k + n) // (2 * n)


def rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def found(known: N.Index, text: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, bucket, first, count, others) of the numbers that the library has; the last of ``rest`` are the numbers."""
    bucket, first, count = known.spans(rest[-1])
    hit = count > 0
    return tuple(x[hit] for x in (text, bucket, first, count, *rest[:-1]))


def runs_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, how often) of ascending numbers from 0."""
    at = np.flatnonzero(np.diff(v, prepend=-1))
    return v[at], np.diff(at, append=len(v))


def pairs(known: N.Index, w: pa.ListArray, gram: int, winnow: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, pair, shared) of slices of whole texts.

    A pair is the text, from the slice's first, times the number of references,
    plus the reference; ascending.
    """
    text, bucket, first, count = found(known, *H.printed(w, gram, winnow))
    for s in N.in_parts(text, count):
        row, ref, _ = known.met(bucket[s], first[s], count[s])
        base, stop = int(text[s][0]), int(text[s][-1]) + 1
        v = (text[s] - base)[row] * known.n_refs + ref
        v.sort()
        yield base, stop, *runs_of(v)


def within(pair: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the pairs, which of ``v``) of those that are pairs."""
    at = np.minimum(np.searchsorted(pair, v), len(pair) - 1)
    there = np.flatnonzero(pair[at] == v)
    return at[there], there


def gram_hits(known: N.Index, grams: tuple[np.ndarray, ...], base: int, stop: int, pair: np.ndarray) -> np.ndarray:
    """How many of the text's grams, with repeats, the reference of each pair has; grams: as ``found`` gives them."""
    lo, hi = np.searchsorted(grams[0], (base, stop))
    text, bucket, first, count = (x[lo:hi] for x in grams)
    k = np.zeros(len(pair), np.int64)
    for s in N.in_parts(text, count):
        row, ref, _ = known.met(bucket[s], first[s], count[s])
        v = (text[s] - base)[row] * known.n_refs + ref
        v.sort()
        v, n = runs_of(v)
        at, there = within(pair, v)
        k[at] += n[there]
    return k


def run_words(known: N.Index, grams: tuple[np.ndarray, ...], base: int, stop: int, pair: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(longest, words) of each pair: its longest run of equal words, and the text's words in any, once each; 0 without a run."""
    lo, hi = np.searchsorted(grams[0], (base, stop))
    text, bucket, first, count, pos = (x[lo:hi] for x in grams)
    longest, words = np.zeros((2, len(pair)), np.int64)
    for s in N.in_parts(text, count):
        row, ref, pb = known.met(bucket[s], first[s], count[s])
        t, ref, start, _, n = N._islands(text[s][row] - base, ref.astype(np.int64), pos[s][row], pb.astype(np.int64))
        at, there = within(pair, t * known.n_refs + ref)
        start, end = start[there], start[there] + n[there] + least - 1
        order = np.lexsort((end, start, at))
        at, start, end = at[order], start[order], end[order]
        np.maximum.at(longest, at, end - start)
        # the furthest end before, of the same pair
        wide = int(end.max(initial=0)) + 1
        upto = np.maximum.accumulate(at * wide + end)
        before = np.concatenate([[0], upto[:-1]]) - at * wide
        np.add.at(words, at, np.maximum(0, end - np.maximum(start, before)))
    return longest, words


def _named(known: N.Index, b: pa.RecordBatch, text: np.ndarray, ref: np.ndarray) -> list[pa.Array]:
    return [b.column(0).take(pa.array(text)), N._flat(known.refs().take(pa.array(ref)))]


def _slices(n: int) -> Iterator[slice]:
    return (slice(i, i + ROWS) for i in range(0, n, ROWS))


def _contained_stage(prints: N.Index, known: N.Index, n: int, winnow: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in N.small(batches):
            w = b.column("w")
            size = np.maximum(w.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) - n + 1, 0)
            text, _, h = H.hashed(w, n)
            grams = found(known, text, h)
            for base, stop, pair, _ in pairs(prints, w, n, winnow):
                k = gram_hits(known, grams, base, stop, pair)
                for s in _slices(len(pair)):
                    t, ref = np.divmod(pair[s], prints.n_refs)
                    total = size[t + base]
                    yield pa.RecordBatch.from_arrays([*_named(prints, b, t + base, ref), pa.array(micro(k[s], np.maximum(total, 1)) / 1e6, mask=total == 0)], ["key", "ref", f"containment{n}"])

    return run


def _kinds(texts: DataFrame, library: DataFrame) -> str:
    return "key {}, ref {}, ".format(*(x.schema["key"].dataType.simpleString() for x in (texts, library)))


def contained(texts: DataFrame, library: DataFrame, folder: str, n: int, winnow: int) -> DataFrame:
    """(key, ref, containment): of all pairs, the share of a text's n-grams, with repeats, that its reference has; texts, library: (key, w)."""
    named = N.number(library.select("key").distinct(), folder)
    prints = N.index(named, H.prints(library, n, winnow))
    known = N.index(named, H.grams(library, n).withColumn("pos", F.lit(0)))
    return texts.select("key", "w").mapInArrow(_contained_stage(prints, known, n, winnow), _kinds(texts, library) + f"containment{n} double")


def _best_scores(t: np.ndarray, ref: np.ndarray, shared: np.ndarray, score: np.ndarray, n_refs: int, top: int) -> np.ndarray:
    """Which rows are among the first ``top`` of their text by score, shared and the smaller reference; t, then ref, ascending."""
    high, most = int(score.max()) + 1, int(shared.max()) + 1
    if float(t[-1] + 1) * high * most * n_refs < 2**62:
        v = np.sort(((t * high + high - 1 - score) * most + most - 1 - shared) * n_refs + ref)
        by = v // (high * most * n_refs)
        starts = np.flatnonzero(np.diff(by, prepend=-1))
        v = v[np.arange(len(v)) - np.repeat(starts, np.diff(starts, append=len(v))) < top]
        return np.searchsorted(t * n_refs + ref, v // (high * most * n_refs) * n_refs + v % n_refs)
    order = np.lexsort((ref, -shared, -score, t))
    starts = np.flatnonzero(np.diff(t[order], prepend=-1))
    return order[np.arange(len(t)) - np.repeat(starts, np.diff(starts, append=len(t))) < top]


def _report_stage(prints: N.Index, known: N.Index, longer: N.Index, n: int, winnow: int, least: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in N.small(batches):
            w = b.column("w")
            size = w.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            text, _, h = H.hashed(w, n)
            grams = found(known, text, h)
            text, pos, h = H.hashed(w, least)
            long = found(longer, text, pos, h)
            for base, stop, pair, shared in pairs(prints, w, n, winnow):
                t, ref = np.divmod(pair, prints.n_refs)
                total = np.maximum(size[t + base] - n + 1, 0)
                cont = micro(gram_hits(known, grams, base, stop, pair), np.maximum(total, 1))
                longest, words = run_words(longer, long, base, stop, pair, least)
                score = np.maximum(cont, micro(words, np.maximum(size[t + base], 1)))
                i = _best_scores(t, ref, shared, score, prints.n_refs, top)
                yield pa.RecordBatch.from_arrays([*_named(prints, b, t[i] + base, ref[i]), pa.array(shared[i].astype(np.int64)), pa.array(cont[i] / 1e6, mask=total[i] == 0), pa.array(longest[i]), pa.array(words[i]), pa.array(score[i] / 1e6)], ["key", "ref", "shared", f"containment{n}", "longest", "words", "score"])

    return run


def report(texts: DataFrame, library: DataFrame, folder: str, n: int, winnow: int, least: int, top: int) -> DataFrame:
    """(key, ref, shared, containment, longest, words, score): each text's best of all pairs; texts, library: (key, w)."""
    named = N.number(library.select("key").distinct(), folder)
    prints = N.index(named, H.prints(library, n, winnow))
    known = N.index(named, H.grams(library, n).withColumn("pos", F.lit(0)))
    longer = N.index(named, H.grams(library, least))
    return texts.select("key", "w").mapInArrow(_report_stage(prints, known, longer, n, winnow, least, top), _kinds(texts, library) + f"shared long, containment{n} double, longest long, words long, score double")


# --- terms of references ------------------------------------------------------


@dataclass(frozen=True)
class Shelf:
    """The terms of each part (sentence, or the whole text) of each reference, as files by the reference's number."""

    folder: str
    buckets: int

    def open(self, k: int) -> tuple[np.ndarray, ...]:
        """(h, ref, part, count) of a bucket, by ref and part."""
        if (self.folder, k) not in N._OPEN:
            path = f"{self.folder}/{k}"
            n = os.path.getsize(path) // 20 if os.path.exists(path) else 0
            at = lambda kind, start: np.memmap(path, kind, "r", start, (n,)) if n else np.zeros(0, kind)
            N._OPEN[self.folder, k] = at(np.uint64, 0), at(np.uint32, 8 * n), at(np.uint32, 12 * n), at(np.uint32, 16 * n)
        return N._OPEN[self.folder, k]


def _terms_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, parts: array of word arrays) to a row a word."""
    for b in batches:
        row, part, h = part_terms(b.column("parts"))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(part.astype(np.int32)), pa.array(h.view(np.int64))], ["key", "part", "h"])


def part_terms(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, part, number) of each word of a batch of arrays of word arrays."""
    n = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at, _, h = H.hashed(parts.flatten(), 1)
    return row[at], part[at], h


def _shelf_stage(folder: str):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(c).to_numpy() for c in ("h", "no", "part")) for b in batches]
        h, no, part = (np.concatenate(x) for x in zip(*parts))
        h = h.view(np.uint64)
        order = np.lexsort((h, part, no))
        h, no, part = h[order], no[order], part[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (no[1:] != no[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        temporary = f"{folder}/{uuid.uuid4().hex}"
        with open(temporary, "wb") as out:
            for x in (h[at], no[at].astype(np.uint32), part[at].astype(np.uint32), np.diff(at, append=len(h)).astype(np.uint32)):
                x.tofile(out)
        os.replace(temporary, f"{folder}/{key[0].as_py()}")
        yield pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int64())], ["n"])

    return run


def shelf(named: N.Numbers, library: DataFrame, parts: Column) -> Shelf:
    """Files of a library's terms; library: (key, ...), parts: an array of word arrays."""
    spark = library.sparkSession
    path = f"{named.folder}/{uuid.uuid4().hex}"
    os.makedirs(path)
    kind = library.schema["key"].dataType.simpleString()
    rows = library.select("key", parts.alias("parts")).mapInArrow(_terms_stage, f"key {kind}, part int, h long")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.join(named.rows, "key").select((F.col("no") % buckets).cast("int").alias("bucket"), "h", "no", "part").groupBy("bucket").applyInArrow(_shelf_stage(path), "n long").agg(F.sum("n")).collect()  # one row
    return Shelf(path, buckets)


def _chunks(n: np.ndarray) -> Iterator[slice]:
    """Slices of rows that unfold to ROWS at most, where one doesn't alone."""
    upto = np.concatenate([[0], np.cumsum(n)])
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + ROWS, "right")) - 1)
        yield slice(i, j)
        i = j


def _unfold(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each row, n of them."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _sums(table: np.ndarray, term: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of c * d, c * c and d * d over the terms that both have; whole numbers, exact."""
    n = hi - lo
    at = _unfold(lo, n)
    c = table[term[at] + np.repeat(begin, n)]
    there = np.flatnonzero(c)
    c, d = c[there].astype(float), d[at[there]]
    cut = np.searchsorted(there, np.concatenate([[0], np.cumsum(n)]))

    def part(v: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(v)])[cut])

    return part(c * d), part(c * c), part(d * d)


def _cosine_stage(prints: N.Index, terms: Shelf, n: int, winnow: int):
    one = np.log(1.5) + 1  # idf where one text of the pair has the term; 1 where both have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in N.small(batches):
            text, _, h = H.hashed(b.column("w"), 1)
            vocabulary, code, often = np.unique(h, return_inverse=True, return_counts=True)
            size = max(1, len(vocabulary))
            rank = np.empty(len(vocabulary), np.int64)  # frequent terms lie side by side
            rank[np.argsort(-often, kind="stable")] = np.arange(len(vocabulary))
            t, c = np.unique(text * size + rank[code], return_counts=True)
            t, term = np.divmod(t, size)
            q1, edge = np.bincount(t, c.astype(float) ** 2, b.num_rows), np.searchsorted(t, np.arange(b.num_rows + 1))
            block = max(1, min(b.num_rows, CELLS // size))
            table = np.zeros(block * size, np.float32)
            for base, stop, pair, _ in pairs(prints, b.column("w"), n, winnow):
                mine, ref = np.divmod(pair, prints.n_refs)
                mine += base
                dot, s1, s2, q2 = np.zeros((4, len(pair)))
                bucket = ref % terms.buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(terms.buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    at = order[cuts[k] : cuts[k + 1]]
                    known, no, _, d = terms.open(int(k))
                    no, d = no.astype(np.int64), d.astype(float)
                    lo, hi = np.searchsorted(no, ref[at]), np.searchsorted(no, ref[at], "right")
                    whole = np.concatenate([[0.0], np.cumsum(d * d)])
                    q2[at] = whole[hi] - whole[lo]
                    place = np.minimum(np.searchsorted(vocabulary, known), size - 1)
                    met = vocabulary[place] == known
                    upto = np.concatenate([[0], np.cumsum(met)])
                    lo, hi, theirs, d = upto[lo], upto[hi], rank[place[met]], d[met]
                    for begin in range(base, stop, block):
                        i, j = np.searchsorted(mine[at], (begin, begin + block))
                        if i == j:
                            continue
                        span = slice(edge[begin], edge[min(begin + block, b.num_rows)])
                        cells = (t[span] - begin) * size + term[span]
                        table[cells] = c[span]
                        for s in _chunks(hi[i:j] - lo[i:j]):
                            s = slice(i + s.start, i + s.stop)
                            dot[at[s]], s1[at[s]], s2[at[s]] = _sums(table, theirs, d, lo[s], hi[s], (mine[at[s]] - begin) * size)
                        table[cells] = 0
                n1, n2 = (q1[mine] - s1) * one * one + s1, (q2 - s2) * one * one + s2
                cosine = rounded(dot / np.sqrt(n1 * n2))
                for s in _slices(len(pair)):
                    yield pa.RecordBatch.from_arrays([*_named(prints, b, mine[s], ref[s]), pa.array(cosine[s])], ["key", "ref", "cosine"])

    return run


def cosines(texts: DataFrame, library: DataFrame, folder: str, n: int, winnow: int) -> DataFrame:
    """(key, ref, cosine) of all pairs, as ``similarity.tfidf_cosine`` defines it; texts, library: (key, w)."""
    named = N.number(library.select("key").distinct(), folder)
    prints = N.index(named, H.prints(library, n, winnow))
    terms = shelf(named, library, F.array("w"))
    return texts.select("key", "w").mapInArrow(_cosine_stage(prints, terms, n, winnow), _kinds(texts, library) + "cosine double")


def _gathered(terms: Shelf, refs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place among refs, part, h, count) of all terms of the references."""
    out = []
    bucket = refs % terms.buckets
    for k in np.unique(bucket):
        mine = np.flatnonzero(bucket == k)
        h, no, part, d = terms.open(int(k))
        no = no.astype(np.int64)
        lo = np.searchsorted(no, refs[mine])
        n = np.searchsorted(no, refs[mine], "right") - lo
        at = _unfold(lo, n)
        out.append((np.repeat(mine, n), part[at].astype(np.int64), h[at], d[at].astype(float)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _sentences_stage(prints: N.Index, terms: Shelf, n: int, winnow: int, top: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in N.small(batches):
            text, part, h = part_terms(b.column("parts"))
            vocabulary, code = np.unique(h, return_inverse=True)
            size, wide = max(1, len(vocabulary)), int(part.max(initial=0)) + 1
            key, c = np.unique((text * wide + part) * size + code, return_counts=True)
            key, term = np.divmod(key, size)
            t, i = np.divmod(key, wide)
            c = c.astype(float)
            parts = np.zeros(b.num_rows, np.int64)
            np.maximum.at(parts, t, i + 1)
            first = np.cumsum(parts) - parts
            norm = np.sqrt(np.bincount(first[t] + i, c * c, parts.sum()))
            edge = np.searchsorted(t, np.arange(b.num_rows + 1))
            for mine, ref, _, _ in N.best_pairs(prints, b.column("w"), n, winnow, top):
                refs, r = np.unique(ref, return_inverse=True)
                whose, j, known, d = _gathered(terms, refs)
                theirs = np.zeros(len(refs), np.int64)
                np.maximum.at(theirs, whose, j + 1)
                begin = np.cumsum(theirs) - theirs
                their_norm = np.sqrt(np.bincount(begin[whose] + j, d * d, theirs.sum()))
                place = np.minimum(np.searchsorted(vocabulary, known), size - 1)
                met = vocabulary[place] == known
                v = whose[met] * size + place[met]
                order = np.argsort(v, kind="stable")
                j, d = j[met][order], d[met][order]
                v, many = runs_of(v[order])
                start = np.cumsum(many) - many
                lo, rows, cells = edge[mine], edge[mine + 1] - edge[mine], parts[mine] * theirs[r]
                for s in _chunks(np.maximum(rows, cells)):
                    if not len(v):
                        continue
                    at = _unfold(lo[s], rows[s])
                    p = np.repeat(np.arange(s.stop - s.start), rows[s])
                    hit, there = within(v, r[s][p] * size + term[at])
                    p, at, count = p[there], at[there], many[hit]
                    offset = np.cumsum(cells[s]) - cells[s]
                    cell = offset[p] + i[at] * theirs[r[s]][p]
                    dots = np.zeros(cells[s].sum())
                    for x in N.in_parts(p, count):
                        met = _unfold(start[hit[x]], count[x])
                        where = np.repeat(cell[x], count[x]) + j[met]
                        low, high = int(where.min()), int(where.max()) + 1
                        dots[low:high] += np.bincount(where - low, np.repeat(c[at[x]], count[x]) * d[met], high - low)
                    some = np.flatnonzero(dots)
                    p = np.searchsorted(offset, some, "right") - 1
                    one, other = np.divmod(some - offset[p], theirs[r[s]][p])
                    similarity = rounded(dots[some] / (norm[first[mine[s]][p] + one] * their_norm[begin[r[s]][p] + other]))
                    keep = similarity >= least
                    p, one, other, similarity = p[keep], one[keep], other[keep], similarity[keep]
                    order = np.lexsort((other, -similarity, one, p))
                    p, one, other, similarity = p[order], one[order], other[order], similarity[order]
                    new = np.ones(len(p), bool)
                    new[1:] = (p[1:] != p[:-1]) | (one[1:] != one[:-1])
                    p, one, other, similarity = p[new], one[new], other[new], similarity[new]
                    yield pa.RecordBatch.from_arrays([*_named(prints, b, mine[s][p], ref[s][p]), pa.array(one.astype(np.int32)), pa.array(other.astype(np.int32)), pa.array(similarity)], ["key", "ref", "i", "j", "similarity"])

    return run


def sentences(texts: DataFrame, library: DataFrame, folder: str, n: int, winnow: int, top: int, least: float) -> DataFrame:
    """(key, ref, i, j, similarity): each sentence's best in each of the ``top`` references of its text; texts, library: (key, w, parts), parts the sentences' words."""
    named = N.number(library.select("key").distinct(), folder)
    prints = N.index(named, H.prints(library, n, winnow))
    terms = shelf(named, library, F.col("parts"))
    return texts.select("key", "w", "parts").mapInArrow(_sentences_stage(prints, terms, n, winnow, top, least), _kinds(texts, library) + "i int, j int, similarity double")
