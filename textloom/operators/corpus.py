"""Corpus building: samples, splits, sampling, duplicates, mixtures and augmentation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.functions.tokenarrays import TokenBatch, mix64, window_hashes
from textloom.operators.sentencetable import by_key, spread
from textloom.session import materialize


def seeded(*parts: Column | str, seed: str = "7") -> Column:
    """A 60-bit number from the md5 of seed and parts; the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def uniform(*parts: Column | str, seed: str = "7") -> Column:
    """A number in [0, 1) from ``seeded``."""
    return seeded(*parts, seed=seed) / F.lit(float(1 << 60))


def hashed_rank(rows: DataFrame, by: list[str], order: Column, tie: str, name: str = "_rn", total: str | None = None) -> DataFrame:
    """Adds the rank from 1 of each row within its stratum, by a hex hash and ``tie``; with total, the stratum's rows.

    The same as one window a stratum, in two steps: rows are numbered within
    the 4096 ranges of the hash's first digits, and what comes before a range
    is summed from counts.  So a stratum of any size is many small sorts.
    """
    x = rows.withColumn("_h", order).withColumn("_s", F.struct(*by)).withColumn("_k", F.substring("_h", 1, 3))
    counts = x.groupBy("_s", "_k").agg(F.count("*").alias("_c"))
    stratum = Window.partitionBy("_s")  # at most 4096 rows a stratum
    counts = counts.withColumn("_b", F.coalesce(F.sum("_c").over(stratum.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(stratum))
    local = F.row_number().over(Window.partitionBy("_s", "_k").orderBy("_h", tie))
    out = x.join(counts, ["_s", "_k"]).withColumn(name, local + F.col("_b"))
    if total is not None:
        out = out.withColumn(total, F.col("_n"))
    return out.drop("_h", "_s", "_k", "_c", "_b", "_n")


def genre(domain: Column) -> Column:
    out = F.lit("unknown")
    for k, v in L.GENRES.items():
        out = F.when(domain == k, v).otherwise(out)
    return out


def make_samples(docs: DataFrame) -> DataFrame:
    """Adds sample_id, n_words, author_type, genre and group_key to documents."""
    short = F.substring(F.sha1("text"), 1, 16)
    source = F.coalesce("source", F.lit(""))
    return docs.withColumns(
        {
            "sample_id": F.concat_ws(":", source, F.coalesce("domain", F.lit("unknown")), F.coalesce("generator", F.lit("none")), short),
            "n_words": T.count_words(F.col("text")),
            "author_type": F.when(F.col("label") == 1, "ai").when(F.col("label") == 0, "human"),
            "genre": genre(F.col("domain")),
            "group_key": F.coalesce("group_id", F.concat(source, F.lit(":"), short)),
        }
    )


def min_length(docs: DataFrame, least: int = 40) -> DataFrame:
    return docs.where(T.count_words(F.col("text")) >= least)


def truncate_words(sentences: DataFrame, most: Column) -> DataFrame:
    """(doc_id, text, n_words): whole sentences until the words before reach ``most``.

    sentences: doc_id, idx, s, w, and whatever columns ``most`` needs.
    """
    upto = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = sentences.withColumn("_n", F.size("w")).withColumn("_cum", F.sum("_n").over(upto)).where(F.col("_cum") - F.col("_n") < most)
    return cum.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "s"))), lambda x: x["s"]), " ").alias("text"), F.sum("_n").alias("n_words"))


def group_split(samples: DataFrame, test: float, calib: float, seed: str = "7", forced: Column | None = None) -> DataFrame:
    """(group_key, split): whole groups to test, calib and train in each stratum.

    A group's stratum is that of its first sample by id.  Groups are ordered
    by seeded hash in a stratum; the first round(n * test) are test, the next
    round(n * calib) calib (halves to even).  Forced groups are test.
    samples: id, group_key, stratum.
    """
    groups = samples.groupBy("group_key").agg(F.min_by("stratum", "id").alias("stratum"), F.max(forced if forced is not None else F.lit(False)).alias("forced"))
    free = groups.where(~F.col("forced"))
    free = hashed_rank(free, ["stratum"], F.md5(F.concat(F.lit(seed), F.col("group_key"))), "group_key", "rn", "n")
    n_test, n_calib = F.bround(F.col("n") * test), F.bround(F.col("n") * calib)
    split = F.when(F.col("rn") <= n_test, "test").when(F.col("rn") <= n_test + n_calib, "calib").otherwise("train")
    return free.select("group_key", "stratum", split.alias("split")).unionByName(groups.where("forced").select("group_key", "stratum", F.lit("test").alias("split")))


def capped(rows: DataFrame, by: list[str], key: str, cap: int, seed: str = "7") -> DataFrame:
    """At most ``cap`` rows a group, by seeded hash order."""
    return hashed_rank(rows, by, F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).where(F.col("_rn") <= cap).drop("_rn")


def parity_half(key: Column) -> Column:
    """0 or 1: the parity of the sha1 of the key as a number."""
    return F.conv(F.right(F.sha1(key), F.lit(1)), 16, 10).cast("int") % 2


def round_robin(rows: DataFrame, key: str, names: list[str], column: str) -> DataFrame:
    """Names in turn over the rows in key order.

    Numbers come from sorted partitions and their sizes, not from one window
    over all rows.
    """
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ordered = materialize(ordered, "ordered")  # partition numbers must be the same in both uses
    sizes = sorted((r._p, r.n) for r in ordered.groupBy("_p").agg(F.count("*").alias("n")).collect())  # a row a partition
    before, start = [], 0
    for p, n in sizes:
        before.append((p, start))
        start += n
    shift = F.broadcast(spark.createDataFrame(before or [(0, 0)], "_p int, _b long"))
    number = F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return ordered.join(shift, "_p").withColumn(column, F.element_at(F.array(*[F.lit(x) for x in names]), (number % len(names) + 1).cast("int"))).drop("_p", "_m", "_b")


def exact_dedup(samples: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """The first of equal texts in the order of the splits, then by id."""
    rank = F.lit(len(ranks))
    for k, v in ranks.items():
        rank = F.when(F.col("split") == k, v).otherwise(rank)
    # the least (rank, id) of a text: an aggregate with partial results, so that a text of a third of all rows is no skew
    first = samples.groupBy(F.sha1("text").alias("_h")).agg(F.min(F.struct(rank.alias("r"), F.col("id").alias("id"))).alias("m"))
    return samples.join(first.select(F.col("m.id").alias("id")), "id", "left_semi")


def class_balanced(rows: DataFrame, label: str, key: str, seed: str = "7") -> DataFrame:
    """Rows repeated until every class has as many as the largest: ``times`` copies each."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n").alias("_most"))
    ranked = hashed_rank(rows, [label], F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key, "_rank")
    joined = ranked.join(counts, label).crossJoin(F.broadcast(most))  # one row
    times = F.floor(F.col("_most") / F.col("_n")) + F.when(F.col("_rank") <= F.col("_most") % F.col("_n"), 1).otherwise(0)
    return joined.withColumn("times", times.cast("int")).drop("_n", "_most", "_rank")


def group_folds(rows: DataFrame, group: str, k: int, seed: str = "7") -> DataFrame:
    """A fold from 0 to k - 1 for every row; groups stay whole."""
    return rows.withColumn("fold", (seeded(group, seed=seed) % k).cast("int"))


def with_shingles(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """Adds ``sh``: the set of windows of ``width`` words, as 60-bit md5 hashes; a shorter text is one window.

    The words are a column of their own first: inside a lambda their
    expression would run once a window.
    """

    def hashed(x: Column) -> Column:
        return F.conv(F.substring(F.md5(F.array_join(x, " ")), 1, 15), 16, 10).cast("long")

    w = F.col("_w")
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: hashed(F.slice(w, i, width)))
    rows = docs.withColumn("_w", F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return rows.withColumn("sh", F.array_distinct(F.when(F.size(w) >= width, many).otherwise(F.array(hashed(w))))).drop("_w")


def _sets_stage(width: int, perms: int = 0):
    seeds = mix64(np.arange(1, perms + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                part = whole.slice(lo, 2000)
                batch = TokenBatch(part.column("text").to_pylist())
                h, at = window_hashes(batch, width)
                edge = np.searchsorted(at, np.arange(len(batch) + 1))
                sets = []
                for i, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                    if a < b:
                        sets.append(np.unique(h[a:b]))
                    else:  # too short for a window: one of all its tokens
                        t = batch.hashes[batch.offsets[i] : batch.offsets[i + 1]]
                        sets.append(mix64(np.array([np.bitwise_xor.reduce(mix64(t + np.arange(len(t), dtype=np.uint64)))], np.uint64)))
                if perms:
                    sets = [np.array([mix64(x ^ s).min() for s in seeds], np.uint64) for x in sets]
                flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
                bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], ["key", "sh"])

    return run


def window_sets(docs: DataFrame, key: str, text: str = "text", width: int = 5, perms: int = 0) -> DataFrame:
    """(key, sh): 64-bit window sets, hashed in numpy; with perms, their MinHash signatures instead."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_sets_stage(width, perms), f"key {dict(docs.dtypes)[key]}, sh array<long>")


def length_augment(sentences: DataFrame, docs: DataFrame, least: int = 50, share: float = 0.7, seed: str = "7") -> DataFrame:
    """Documents of at least 150 words cut to a seeded length between ``least`` and ``share`` of them."""
    words = sentences.groupBy("doc_id").agg(F.sum(F.size("w")).alias("n")).where("n >= 150")
    goal = words.select("doc_id", "n", F.floor(F.lit(least) + uniform("doc_id", seed=seed) * (F.col("n") * share - least)).alias("goal"))
    cut = truncate_words(sentences.join(goal.select("doc_id", "goal"), "doc_id"), F.col("goal"))
    return goal.join(cut, "doc_id").where(F.col("n_words") >= least).select("doc_id", "goal", "n_words", "text")


def concatenated(docs: DataFrame, by: list[str], size: int = 3, seed: str = "7") -> DataFrame:
    """Documents of a group joined in threes, in seeded order; a last incomplete one is left out."""
    rows = hashed_rank(docs, by, F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))), "doc_id").withColumn("_rn", F.col("_rn") - 1).withColumn("part", F.floor(F.col("_rn") / size))
    joined = rows.groupBy(*by, "part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("_rn", "doc_id", "text"))).alias("x"))  # size rows each
    return joined.where(F.col("n") == size).select(*by, "part", F.transform("x", lambda v: v["doc_id"]).alias("doc_ids"), F.array_join(F.transform("x", lambda v: v["text"]), "\n\n").alias("text"))


def reorder_sentences(sentences: DataFrame, seed: str = "7") -> DataFrame:
    """Sentences of a paragraph, but for its first, in seeded order where there are more than two."""
    key = F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.col("idx").cast("string"))).alias("h"), F.col("idx"), F.col("s"))
    rows = sentences.groupBy("doc_id", "para").agg(F.array_sort(F.collect_list(F.struct("idx", "s"))).alias("o"), F.collect_list(key).alias("k"))
    first = F.element_at("o", 1)
    rest = F.transform(F.array_sort(F.filter("k", lambda x: x["idx"] != first["idx"])), lambda x: x["s"])
    mixed = F.concat(F.array(first["s"]), rest)
    para = F.array_join(F.when(F.size("o") > 2, mixed).otherwise(F.transform("o", lambda x: x["s"])), " ")
    return rows.select("doc_id", "para", para.alias("p")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "p"))), lambda x: x["p"]), "\n\n").alias("text"))


def casualize(text: Column) -> Column:
    """Contractions for long forms, full stops for semicolons, commas for dashes."""
    for long, short in L.CONTRACTIONS:
        text = F.regexp_replace(text, rf"(?i)\b{long}\b", short)
    text = F.regexp_replace(text, r"; +([\p{L}])", ". $1")
    return F.regexp_replace(text, r" — ", ", ")


def typo_noise(text: Column, key: Column, share: float = 0.03, seed: str = "7") -> Column:
    """A letter swapped, dropped or doubled inside a share of the words of four letters or more."""

    def noisy(w: Column, i: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), i.cast("string"))), 1, 12), 16, 10).cast("long")
        n = F.length(w)
        at = (F.floor(h / 1000) % (n - 3) + 2).cast("int")
        left, x, y, right = w.substr(F.lit(1), at - 1), w.substr(at, F.lit(1)), w.substr(at + 1, F.lit(1)), w.substr(at + 2, n)
        kind = F.floor(h / 1000000) % 3
        changed = F.when(kind == 0, F.concat(left, y, x, right)).when(kind == 1, F.concat(left, y, right)).otherwise(F.concat(left, x, x, y, right))
        return F.when((n >= 4) & w.rlike(r"^\p{L}+$") & (h % 1000 < int(share * 1000)), changed).otherwise(w)

    return F.array_join(F.transform(F.split(text, " "), noisy), " ")


def merge_split(text: Column) -> Column:
    """Neighbouring short sentences joined with "and", long ones cut at a clause mark."""
    parts = T.sentences(text)

    def fold(acc: Column, s: Column) -> Column:
        short = F.size(F.split(s, r"\s+")) < 14
        last = F.element_at(acc, -1)
        join = (F.size(acc) > 0) & short & (F.size(F.split(last, r"\s+")) < 14) & last.endswith(".")
        merged = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.regexp_replace(last, r"\.$", ""), F.lit(", and "), F.lower(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))))
        cut = F.when(F.size(F.split(s, r"\s+")) > 28, F.regexp_replace(s, r"^(.{40,}?), (and|but|so|which|while) ", "$1. $2 ")).otherwise(s)
        return F.when(join, merged).otherwise(F.concat(acc, F.array(cut)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), " ")


def near_duplicates_of_train(samples: DataFrame, threshold: float = 0.5, width: int = 5) -> DataFrame:
    """(id): calib and test samples that share ``threshold`` of their windows (Jaccard) with a train sample.

    Exact, by inverted lists of fronts: windows have one order, rare ones
    first, and sets that are similar enough share a window in the first
    n - ceil(threshold * n) + 1 of either.  Windows on one side only have no
    place in any front.  Copies of a text count once on either side; a front
    window of many texts is joined in as many parts as it needs.
    """
    hashes = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("check"), "text").alias("b"))
    texts = samples.where("split is not null and text is not null").select("id", "split", hashes.alias("h"), "text")
    is_train = (F.col("split") == "train").cast("int")
    sets = window_sets(spread(texts.select(F.struct("h", is_train.alias("t")).alias("k"), "text")), "k", "text", width).select("key.*", "sh")
    sets = materialize(by_key(sets, "h").groupBy("h").agg(F.max("t").alias("t"), F.max(1 - F.col("t")).alias("e"), F.first("sh").alias("sh")), "sets")
    items = sets.select("h", "t", "e", F.size("sh").alias("n"), F.explode("sh").alias("g"))
    # windows that both sides have, and how many texts have them
    both = items.groupBy("g").agg(F.count("*").alias("df"), F.max("t").alias("any_t"), F.max("e").alias("any_e")).where("any_t = 1 and any_e = 1").select("g", "df")
    kept = items.join(both, "g")
    rank = F.row_number().over(Window.partitionBy("h").orderBy("df", "g"))  # the windows of one text
    # a window of one side counts in n and is met by none; it stands behind the others, so that fronts are as long as the others allow
    need = F.ceil(F.col("n") * threshold)
    front = by_key(kept, "h").withColumn("r", rank).withColumn("m", F.count("*").over(Window.partitionBy("h"))).where(F.col("r") <= F.col("m") - need + 1)
    front = materialize(front.select("h", "t", "e", "n", "g"), "fronts")
    hot = 2000
    many = front.groupBy("g").agg(F.count_if(F.col("t") == 1).alias("k")).where(F.col("k") > hot).select("g", F.ceil(F.col("k") / hot).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    train = front.where("t = 1").join(many, "g", "left").select("g", F.pmod(F.xxhash64("h"), parts).cast("int").alias("p"), F.col("h").alias("th"), F.col("n").alias("tn"))
    held = front.where("e = 1").join(many, "g", "left").select("g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"), "h", "n")
    met = held.join(train, ["g", "p"]).where(F.col("n").between(F.col("tn") * threshold, F.col("tn") / threshold)).select("h", "th").distinct()
    a, b = sets.select("h", "sh"), sets.select(F.col("h").alias("th"), F.col("sh").alias("tsh"))
    k = F.size(F.array_intersect("sh", "tsh"))
    near = met.join(a, "h").join(b, "th").where(k >= threshold * (F.size("sh") + F.size("tsh") - k)).select("h").distinct()
    return texts.where("split <> 'train'").join(near, "h", "left_semi").select("id").distinct()


def dedup_report(samples: DataFrame, ranks: dict[str, int], threshold: float = 0.5) -> DataFrame:
    """(split, n, exact_removed, near_removed): samples of each split, those that repeat an earlier text, and of the others those near a train text."""
    there = materialize(samples.where("split is not null and text is not null"), "dedup")
    first = materialize(exact_dedup(there, ranks), "first")
    near = near_duplicates_of_train(first, threshold).withColumn("near", F.lit(1))
    kept = first.select("id").withColumn("kept", F.lit(1)).join(near, "id", "left")
    return there.select("id", "split").join(kept, "id", "left").groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("kept").isNull()).alias("exact_removed"), F.count_if(F.col("near").isNotNull()).alias("near_removed"))


def minhash_candidates(docs: DataFrame, perms: int = 64, rows: int = 4, width: int = 5) -> DataFrame:
    """(a, b, same): documents whose MinHash signatures agree in a band, and those whose window sets are equal.

    Documents with equal window sets are one class (the least id stands for
    it), so that a band bucket never holds copies.  ``same`` is false for a
    pair of two classes, by their ids, equal signatures included; it is true
    for a class and each further document in it (a is the class).
    """
    sets = materialize(window_sets(docs, "doc_id", "text", width).select(F.col("key").alias("doc_id"), F.struct(F.size("sh"), F.xxhash64("sh"), F.xxhash64(F.lit(1), "sh")).alias("s")).distinct(), "classes")
    one = sets.groupBy("s").agg(F.min("doc_id").alias("a"))
    members = sets.join(one, "s").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    texts = docs.join(one.select(F.col("a").alias("doc_id")), "doc_id", "left_semi")
    sig = window_sets(texts, "doc_id", "text", width, perms).select(F.col("key").alias("doc_id"), F.col("sh").alias("sig"))
    band = F.transform(F.sequence(F.lit(0), F.lit(perms // rows - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows)))
    keys = sig.select("doc_id", F.explode(band).alias("key")).distinct()
    met = keys.select(F.col("doc_id").alias("a"), "key").join(keys.select(F.col("doc_id").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    return met.withColumn("same", F.lit(False)).unionByName(members.withColumn("same", F.lit(True)))


def hybrids(docs: DataFrame, sentences: DataFrame, seed: str = "7") -> DataFrame:
    """Spliced documents of a human and a machine part from one domain.

    Humans and machines of a domain are paired in seeded order; a seeded
    pattern (HA, AH, HAH, AHA) and share tell how many sentences either gives;
    parts are joined by a space or a blank line.  Columns: human_id, ai_id,
    pattern, text, segments (start, end, label; offsets of the parts).
    """
    s = sentences.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "s"))).alias("x")).select("doc_id", F.transform("x", lambda v: v["s"]).alias("ss"))
    rich = docs.select("doc_id", "label", "domain").where("domain is not null").join(s, "doc_id").where(F.size("ss") >= 4)
    ranked = hashed_rank(rich, ["domain", "label"], F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))), "doc_id", "rn")
    h = ranked.where("label = 0").select("domain", "rn", F.col("doc_id").alias("human_id"), F.col("ss").alias("h"))
    a = ranked.where("label = 1").select("domain", "rn", F.col("doc_id").alias("ai_id"), F.col("ss").alias("a"))
    pair = h.join(a, ["domain", "rn"]).withColumn("u", seeded("human_id", "ai_id", seed=seed))
    pattern = F.element_at(F.array(F.lit("HA"), F.lit("AH"), F.lit("HAH"), F.lit("AHA")), (F.col("u") % 4 + 1).cast("int"))
    sep = F.when(F.floor(F.col("u") / 4) % 2 == 0, " ").otherwise("\n\n")
    half_h, half_a = F.floor(F.size("h") / 2).cast("int"), F.floor(F.size("a") / 2).cast("int")

    def part(c: str, lo: Column, n: Column) -> Column:
        return F.array_join(F.slice(c, lo, n), " ")

    rows = pair.withColumns({"pattern": pattern, "sep": sep})
    hh, aa = part("h", F.lit(1), F.size("h")), part("a", F.lit(1), F.size("a"))
    h1, h2, a1, a2 = part("h", F.lit(1), half_h), part("h", half_h + 1, F.size("h") - half_h), part("a", F.lit(1), half_a), part("a", half_a + 1, F.size("a") - half_a)
    piece = lambda t, k: F.struct(t.alias("t"), F.lit(k).alias("label"))
    parts = F.when(F.col("pattern") == "HA", F.array(piece(hh, 0), piece(aa, 1))).when(F.col("pattern") == "AH", F.array(piece(aa, 1), piece(hh, 0))).when(F.col("pattern") == "HAH", F.array(piece(h1, 0), piece(aa, 1), piece(h2, 0))).otherwise(F.array(piece(a1, 1), piece(hh, 0), piece(a2, 1)))
    rows = rows.withColumn("parts", parts)
    start = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda acc, x: acc + F.length(x["t"]) + F.length("sep"))
    segments = F.transform("parts", lambda x, i: F.struct(start(i).alias("start"), (start(i) + F.length(x["t"])).alias("end"), x["label"].alias("label")))
    text = F.expr("array_join(transform(parts, x -> x.t), sep)")
    return rows.select("domain", "human_id", "ai_id", "pattern", text.alias("text"), segments.alias("segments"))
