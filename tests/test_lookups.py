"""What pairs of texts and references have in common, by files, by joins and by brute force."""

from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import lookups as L
from textloom.operators import postings as N
from textloom.operators import similarity as I


@pytest.fixture(scope="module")
def corpus():
    draw = np.random.default_rng(11)
    word = lambda x: "abcdefghij"[x % 10] + "pqrs"[x // 10]
    lines = [[word(x) for x in draw.integers(0, 40, 9)] for _ in range(14)]
    made = lambda n: [lines[i] if draw.random() < 0.7 else [word(x) for x in draw.integers(0, 40, 7)] for i in draw.integers(0, 14, n)]
    return {f"t{k}": made(4) for k in range(50)} | {"short": [["a", "b"]], "none": [[]], "twice": [["a"] * 6] * 2}, {k * 7 % 61: made(4) for k in range(40)} | {90: [["a", "b"]], 91: [["a"] * 6, []]}


@pytest.fixture(params=["files", "join"])
def frames(request, spark, corpus, monkeypatch):
    if request.param == "join":
        monkeypatch.setattr(N, "local_folder", lambda _: None)
    left, right = (spark.createDataFrame([(k, x) for k, x in side.items()], f"key {kind}, parts array<array<string>>").select("key", F.flatten("parts").alias("w"), "parts") for side, kind in zip(corpus, ("string", "long")))
    return left, right


def _grams(w, n):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def _prints(w):
    h = [int(md5(" ".join(g).encode()).hexdigest()[:15], 16) for g in _grams(w, 5)]
    return {int(md5(" ".join(w).encode()).hexdigest()[:15], 16)} if 0 < len(w) < 5 else {min(h[i : i + 4]) for i in range(max(1, len(h) - 3))} if h else set()


@pytest.fixture(scope="module")
def pairs(corpus):
    texts, refs = ({k: sum(x, []) for k, x in side.items()} for side in corpus)
    prints = [{k: _prints(w) for k, w in side.items()} for side in (texts, refs)]
    return {(k, r): (a, b, len(prints[0][k] & prints[1][r])) for k, a in texts.items() for r, b in refs.items() if prints[0][k] & prints[1][r]}


def _containment(a, b):
    mine, theirs = _grams(a, 5), set(_grams(b, 5))
    return round(sum(g in theirs for g in mine) / len(mine), 6) if mine else None


def _cosine(a, b):
    a, b = Counter(a), Counter(b)
    one = np.log(1.5) + 1
    length = lambda x, y: np.sqrt(sum((n * (1 if t in y else one)) ** 2 for t, n in x.items()))
    return sum(n * b[t] for t, n in a.items()) / length(a, b) / length(b, a)


def test_containment_is_that_of_brute_force(frames, pairs):
    got = {(r.key, r.ref): r.containment5 for r in I.contained(*frames).collect()}
    assert len(got) > 100 and ("short", 90) in got
    assert got == {k: _containment(a, b) for k, (a, b, _) in pairs.items()}


def test_cosines_are_those_of_brute_force(frames, pairs):
    got = {(r.key, r.ref): r.cosine for r in I.cosines(*frames).collect()}
    assert got == {k: pytest.approx(_cosine(a, b), abs=1e-6) for k, (a, b, _) in pairs.items()}


def _runs(a, b):
    """(longest, words)."""
    longest, words = 0, set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= 8:
                longest = max(longest, n)
                words |= set(range(i, i + n))
    return longest, len(words)


def test_report_is_that_of_brute_force(frames, pairs):
    want = {}
    for (k, r), (a, b, shared) in pairs.items():
        c, (longest, words) = _containment(a, b), _runs(a, b)
        want.setdefault(k, []).append((-max(c or 0, round(words / max(len(a), 1), 6)), -shared, r, c, longest, words))
    want = sorted((k, r, -shared, c, longest, words, -score) for k, x in want.items() for score, shared, r, c, longest, words in sorted(x)[:4])
    text, ref = (x.select("key", F.array_join("w", " ").alias("text")) for x in frames)
    assert sorted(map(tuple, I.similarity_report(text, "key", ref, "key", 4).collect())) == want


def test_sentences_are_those_of_brute_force(frames, corpus, pairs):
    want = []
    for k in {k for k, _ in pairs}:
        for _, r in sorted((-n, r) for (x, r), (_, _, n) in pairs.items() if x == k)[:5]:
            for i, a in enumerate(corpus[0][k]):
                sims = []
                for j, b in enumerate(corpus[1][r]):
                    x, y = Counter(a), Counter(b)
                    if a and b:
                        sims.append((-round(sum(n * y[w] for w, n in x.items()) / np.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values())), 6), j))
                if sims and min(sims)[0] <= -0.8:
                    want.append((k, r, i, min(sims)[1], -min(sims)[0]))
    got = I.best_sentences(*frames, 5).collect()
    assert len(got) > 50 and sorted(map(tuple, got)) == sorted(want)


def test_best_scores_are_the_same_where_they_do_not_fit_a_word():
    draw = np.random.default_rng(3)
    t = np.repeat(np.arange(20), 30)
    ref, shared, score = np.tile(np.arange(30), 20), draw.integers(1, 4, 600), draw.integers(0, 5, 600)
    want = {(t[i], ref[i]) for i in L._best_scores(t, ref, shared, score, 30, 7)}
    assert len(want) == 140 and want == {(t[i], ref[i]) for i in L._best_scores(t, ref, shared, score, 1 << 60, 7)}


def test_files_need_no_shuffle_of_pairs(spark, corpus):
    """What meets stays within a text's task: plans that read texts have no exchange."""
    left, right = (spark.createDataFrame([(k, x) for k, x in side.items()], f"key {kind}, parts array<array<string>>").select("key", F.flatten("parts").alias("w"), "parts") for side, kind in zip(corpus, ("string", "long")))
    text, ref = (x.select("key", F.array_join("w", " ").alias("text")) for x in (left, right))
    for df in (I.contained(left, right), I.cosines(left, right), I.best_sentences(left, right), I.similarity_report(text, "key", ref, "key")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
