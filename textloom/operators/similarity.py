"""Text overlap with a reference library: fingerprints, containment, runs, cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import hashedgrams as H
from textloom.functions import text as T
from textloom.functions.stats import r6
from textloom.operators import lookups as L
from textloom.operators import postings as N

GRAM, WINNOW = 5, 4


def tokens(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, w): folded words."""
    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), T.words(F.col(text)).alias("w"))


def _hash(gram: Column) -> Column:
    """31-bit number of a gram, as crc32 gives it."""
    return F.crc32(gram.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF))


def grams(docs: DataFrame, key: str, n: int, text: str = "text") -> DataFrame:
    """(key, pos, g): word n-grams from 0; shorter texts have none."""
    # outer, and no filter on the words before: either would compute them again below
    made = F.expr(f"case when size(w) >= {n} then transform(sequence(1, size(w) - {n - 1}), i -> concat_ws(' ', slice(w, i, {n}))) end")
    return tokens(docs, key, text).select("key", F.posexplode_outer(made).alias("pos", "g")).where("pos is not null")


def winnow(docs: DataFrame, key: str, text: str = "text", hashed=_hash) -> DataFrame:
    """(key, h): the least hash of each run of four 5-gram hashes, as a set.

    Texts of one to four grams give their least hash; texts under five words
    one hash of all words; empty texts none.
    """
    h = grams(docs, key, GRAM, text).select("key", "pos", hashed(F.col("g")).alias("h"))
    order = Window.partitionBy("key").orderBy("pos")
    frame = order.rowsBetween(0, WINNOW - 1)
    h = h.withColumns({"m": F.min("h").over(frame), "k": F.count("*").over(frame), "n": F.count("*").over(Window.partitionBy("key"))})
    long = h.where(f"k = {WINNOW} or (n < {WINNOW} and pos = 0)").select("key", F.col("m").alias("h")).distinct()
    short = tokens(docs, key, text).where((F.size("w") < GRAM) & (F.size("w") > 0)).select("key", hashed(F.array_join("w", " ")).alias("h"))
    return long.unionByName(short)


def sharing(prints: DataFrame, index: DataFrame) -> DataFrame:
    """(key, ref, shared): all references that share a fingerprint with a text; no cap.

    A run of eight equal words has four equal 5-grams, so that its texts always
    share one.
    """
    return prints.join(index.select(F.col("key").alias("ref"), "h"), "h").groupBy("key", "ref").agg(F.count("*").alias("shared"))


def candidates(texts: DataFrame, library: DataFrame, top: int = 20) -> DataFrame:
    """(key, ref, shared, rank): references by shared fingerprints (md5), the best ``top`` of each text.

    texts, library: (key, w).  Ties go to the smaller reference.  The top is an
    operator's parameter: a report of the best, not a bound on what is
    compared.  Texts look the fingerprints up in files where the shared folder
    is one of the file system; else both meet in a join.
    """
    if (folder := N.local_folder(texts.sparkSession)) is not None:
        return N.best(texts, library, folder, GRAM, WINNOW, top)
    hits = _pairs(texts, library)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("shared"), "ref"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top)


def _pairs(texts: DataFrame, library: DataFrame) -> DataFrame:
    """``sharing`` of (key, w) by md5, in a join."""
    return sharing(*(H.prints(x, GRAM, WINNOW).select("key", "h").distinct() for x in (texts, library)))


def containment(pairs: DataFrame, left: DataFrame, right: DataFrame, n: int, many: bool = False) -> DataFrame:
    """(key, ref, containment): share of a text's n-grams, with repeats, that its reference has.

    many: where pairs are nearly all that share anything, grams meet first and
    pairs after; the rows are the same.
    """
    total = left.groupBy("key").agg(F.count("*").alias("n"))
    mine = left.groupBy("key", "g").agg(F.count("*").alias("c"))
    theirs = right.select(F.col("key").alias("ref"), "g").distinct()
    met = mine.join(theirs, "g") if many else pairs.select("key", "ref").join(mine, "key").join(theirs, ["ref", "g"])
    hit = met.groupBy("key", "ref").agg(F.sum("c").alias("k"))
    return pairs.select("key", "ref").join(total, "key", "left").join(hit, ["key", "ref"], "left").select("key", "ref", r6(F.coalesce("k", F.lit(0)) / F.col("n")).alias(f"containment{n}"))


def contained(texts: DataFrame, library: DataFrame, n: int = GRAM) -> DataFrame:
    """(key, ref, containment) of all pairs that share a fingerprint (md5); texts, library: (key, w), a text's key once.

    Texts look both up in files where the shared folder is one of the file
    system; else they meet in joins.
    """
    if (folder := N.local_folder(texts.sparkSession)) is not None:
        return L.contained(texts, library, folder, n, WINNOW)
    return containment(_pairs(texts, library), H.grams(texts, n).withColumnRenamed("h", "g"), H.grams(library, n).withColumnRenamed("h", "g"), n, many=True)


def exact_runs(texts: DataFrame, library: DataFrame, least: int = 8) -> DataFrame:
    """(key, ref, start, ref_start, length): maximal runs of equal words of at least ``least``, of every text with every reference.

    texts, library: (key, w).  Equal grams of ``least`` words meet on their
    diagonal; gaps and islands join neighbours.  Texts look the grams up in
    files where the shared folder is one of the file system; else both meet in
    a join.
    """
    if (folder := N.local_folder(texts.sparkSession)) is not None:
        return N.runs(texts, library, folder, least)
    left, right = H.grams(texts, least, H.known(library, least)), H.grams(library, least)
    hits = left.select("key", F.col("pos").alias("pa"), "h").join(right.select(F.col("key").alias("ref"), F.col("pos").alias("pb"), "h"), "h").withColumn("diag", F.col("pa") - F.col("pb"))
    order = Window.partitionBy("key", "ref", "diag").orderBy("pa")
    hits = hits.withColumn("island", F.col("pa") - F.row_number().over(order))
    return hits.groupBy("key", "ref", "diag", "island").agg(F.min("pa").alias("start"), F.min("pb").alias("ref_start"), (F.count("*") + least - 1).alias("length")).select("key", "ref", "start", "ref_start", "length")


def tfidf_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, ref, cosine): of term counts times ln(3 / (1 + df)) + 1, where df counts the two texts of the pair.

    left, right: (key, w).  The terms of each text are counted once; pairs
    bring them together.
    """
    def counts(t: DataFrame) -> DataFrame:
        return t.select("key", F.explode("w").alias("t")).groupBy("key", "t").agg(F.count("*").cast("double").alias("c"))

    one, both = F.log(F.lit(1.5)) + 1, F.lit(1.0)  # idf where df is 1, and where it is 2
    lc, rc = counts(left), counts(right)
    shared = pairs.select("key", "ref").join(lc, "key").join(rc.select(F.col("key").alias("ref"), "t", F.col("c").alias("d")), ["ref", "t"]).groupBy("key", "ref").agg(F.sum(F.col("c") * F.col("d")).alias("dot"), F.sum(F.col("c") * F.col("c")).alias("s1"), F.sum(F.col("d") * F.col("d")).alias("s2"))
    l2, r2 = lc.groupBy("key").agg(F.sum(F.col("c") * F.col("c")).alias("q1")), rc.groupBy(F.col("key").alias("ref")).agg(F.sum(F.col("c") * F.col("c")).alias("q2"))
    x = pairs.select("key", "ref").join(l2, "key").join(r2, "ref").join(shared, ["key", "ref"], "left")
    z = F.lit(0.0)
    n1 = (F.col("q1") - F.coalesce("s1", z)) * one * one + F.coalesce("s1", z) * both
    n2 = (F.col("q2") - F.coalesce("s2", z)) * one * one + F.coalesce("s2", z) * both
    return x.select("key", "ref", r6(F.coalesce("dot", z) / F.sqrt(n1 * n2)).alias("cosine"))


def cosines(texts: DataFrame, library: DataFrame) -> DataFrame:
    """(key, ref, cosine): ``tfidf_cosine`` of all pairs that share a fingerprint (md5), looked up as in ``contained``."""
    if (folder := N.local_folder(texts.sparkSession)) is not None:
        return L.cosines(texts, library, folder, GRAM, WINNOW)
    return tfidf_cosine(_pairs(texts, library), texts, library)


def coverage(texts: DataFrame, library: DataFrame, least: int = 8) -> DataFrame:
    """(key, covered): share of a text's words in any run of at least ``least`` equal words; runs of several references count once.

    texts, library: (key, w).  A word is in a run where it is in a gram of so
    many words that the library has, so that texts meet the library's distinct
    grams and never its texts: no row a pair.
    """
    theirs = H.grams(library, least).select("h").distinct()
    hits = H.grams(texts, least, H.known(library, least)).join(theirs, "h", "left_semi")
    hits = hits.groupBy("key").agg(F.array_sort(F.collect_list("pos")).alias("p"))  # at most a text's words
    # each gram adds the words after the gram before
    new = F.transform(F.col("p"), lambda x, i: F.when(i == 0, F.lit(least)).otherwise(F.least(F.lit(least), x - F.get("p", i - 1))))
    k = hits.select("key", F.aggregate(new, F.lit(0), lambda a, x: a + x).alias("k"))
    return texts.select("key", F.size("w").alias("n")).where("n > 0").join(k, "key", "left").select("key", r6(F.coalesce("k", F.lit(0)) / F.col("n")).alias("covered"))


def matching_words(runs: DataFrame) -> DataFrame:
    """(key, ref, longest, words): the longest run, and how many words of the text lie in runs with the reference; each word counts once."""
    order = Window.partitionBy("key", "ref").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    r = runs.withColumn("stop", F.col("start") + F.col("length")).withColumn("before", F.max("stop").over(order))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("before", F.col("start"))))
    return r.groupBy("key", "ref").agg(F.max("length").alias("longest"), F.sum(new).alias("words"))


def sentence_matches(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """(key, ref, i, j, similarity): for each sentence i of a text, its best sentence j of a reference, from ``least`` on.

    The cosine of word counts; ties go to the earlier sentence.  pairs: (key,
    ref); left, right: (key, idx, w).  Sentences meet by pair and word.
    """

    def counted(t: DataFrame) -> DataFrame:
        words = t.select("key", "idx", F.explode_outer("w").alias("word")).where("word is not null").groupBy("key", "idx", "word").agg(F.count("*").cast("double").alias("c"))
        norm = words.groupBy("key", "idx").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
        return words.join(norm, ["key", "idx"])

    a = counted(left).select("key", F.col("idx").alias("i"), "word", F.col("c").alias("ci"), F.col("n").alias("ni"))
    b = counted(right).select(F.col("key").alias("ref"), F.col("idx").alias("j"), "word", F.col("c").alias("cj"), F.col("n").alias("nj"))
    met = pairs.select("key", "ref").join(a, "key").join(b, ["ref", "word"])
    sims = met.groupBy("key", "ref", "i", "j").agg((F.sum(F.col("ci") * F.col("cj")) / (F.first("ni") * F.first("nj"))).alias("s")).withColumn("similarity", r6(F.col("s"))).where(F.col("similarity") >= least)
    best = sims.groupBy("key", "ref", "i").agg(F.max(F.struct("similarity", (-F.col("j")).alias("j"))).alias("m"))
    return best.select("key", "ref", "i", (-F.col("m.j")).alias("j"), F.col("m.similarity").alias("similarity"))


def best_sentences(texts: DataFrame, library: DataFrame, top: int = 10, least: float = 0.8) -> DataFrame:
    """``sentence_matches`` of each text with its ``top`` candidates; texts, library: (key, w, parts), parts the sentences' words.

    All of it is done in the text's own task where files can be looked up.
    """
    if (folder := N.local_folder(texts.sparkSession)) is not None:
        return L.sentences(texts, library, folder, GRAM, WINNOW, top, least)
    left, right = (x.select("key", F.posexplode_outer("parts").alias("idx", "w")).where("idx is not null") for x in (texts, library))
    return sentence_matches(candidates(texts, library, top), left, right, least)


def similarity_report(texts: DataFrame, key: str, library: DataFrame, ref: str, top: int = 10, hashed=None) -> DataFrame:
    """(key, ref, shared, containment5, longest, words, score): each text's best ``top`` references by score.

    The score is max(containment, matched words over length); ``words`` is the
    number of matched words.  All references that share a fingerprint are
    scored, and the top is cut after that.  Ties go to more shared
    fingerprints, then to the smaller reference.  Fingerprints are md5's, looked
    up as in ``contained``, where no ``hashed`` is given.
    """
    if hashed is None and (folder := N.local_folder(texts.sparkSession)) is not None:
        return L.report(tokens(texts, key), tokens(library, ref), folder, GRAM, WINNOW, 8, top)
    pairs = _pairs(tokens(texts, key), tokens(library, ref)) if hashed is None else sharing(winnow(texts, key, hashed=hashed), winnow(library, ref, hashed=hashed))
    left, right = grams(texts, key, GRAM), grams(library, ref, GRAM)
    cont = containment(pairs, left, right, GRAM, many=True)
    runs = matching_words(exact_runs(tokens(texts, key), tokens(library, ref)))
    size = tokens(texts, key).select("key", F.size("w").alias("n"))
    x = pairs.join(cont, ["key", "ref"]).join(runs, ["key", "ref"], "left").join(size, "key")
    score = F.greatest(F.coalesce("containment5", F.lit(0.0)), F.coalesce("words", F.lit(0)) / F.greatest("n", F.lit(1)))
    x = x.select("key", "ref", "shared", "containment5", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("longest", "words")], r6(score).alias("score"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.desc("shared"), "ref"))
    return x.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")
