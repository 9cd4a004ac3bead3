"""Mixing sources to target weights (problem 8).

Sainte-Laguë apportionment: a mix is so many blocks of equal tokens, given to
the sources one by one by the highest quotient weight / (2 seats + 1), as far
as their repeats reach.  A source's quota becomes whole passes over its
documents and a rest; the rest's blocks are apportioned in the same way to
hash shards of the source, and within a shard documents are taken in seeded
order until the shard's quota is full.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.session import materialize

#: Split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class MixSpec:
    """tokenizer: a vocabulary file of ranks, where every executor finds it.

    blocks: blocks of equal tokens a mix is made of.  shard_documents:
    documents a shard holds, about; most_shards: shards of a source at most,
    which bounds what the driver apportions.
    """

    tokenizer: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    blocks: int = 100_000
    shard_documents: int = 2000
    most_shards: int = 4096
    seed: str = "mix"


def sainte_lague(weights: dict, seats: int, most: dict | None = None) -> dict:
    """Seats by highest quotients weight / (2 n + 1); ties go to the first key; none beyond ``most``."""
    got = dict.fromkeys(weights, 0)
    heap = [(-w, k) for k, w in sorted(weights.items()) if w > 0 and (most is None or most.get(k, 0) > 0)]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, k = heap[0]
        got[k] += 1
        if most is not None and got[k] >= most[k]:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, (-weights[k] / (2 * got[k] + 1), k))
    return got


def _encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _token_stage(spec: MixSpec):
    def run(batches):
        encode = _encoder(spec.tokenizer).encode_ordinary
        for b in batches:
            n = [len(encode(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "source": b.column("source"), "n_tokens": pa.array(n, pa.int64())})

    return run


def token_counts(documents: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """(doc_id, source, n_tokens) of documents with any token; source in small letters without outer spaces, null as ''."""
    rows = documents.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long"), F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), "text")
    return rows.mapInArrow(_token_stage(spec), "doc_id long, source string, n_tokens long").where("n_tokens > 0").dropDuplicates(["doc_id"])


def mix_documents(documents: DataFrame, targets: DataFrame, spec: MixSpec = MixSpec(), counted: DataFrame | None = None) -> DataFrame:
    """(mix_name, doc_id, source, n_tokens, uses) of every document used.

    documents: doc_id, source, text; targets: mix_name, source, target_share,
    max_repeats, size_factor.  A source that can't fill its share is used as
    often as allowed, and the others fill the size by their quotients as far
    as they reach.  Sources are matched without case and outer spaces; a
    source named twice in a mix has the sum of its shares and the smaller
    repeats.  Sources without documents and shares or repeats of null or 0
    give nothing; with no documents the result is empty.
    """
    spark = documents.sparkSession
    tokens = counted if counted is not None else materialize(token_counts(documents, spec), "tokens")
    mixes: dict[str, dict[str, tuple[float, int, float]]] = defaultdict(dict)
    goal = targets.where("mix_name is not null and source is not null and target_share > 0 and max_repeats > 0").groupBy("mix_name", F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("m"), F.max("size_factor").alias("f"))
    for r in goal.collect():  # a row a mix and source
        mixes[r.mix_name][r.source] = (r.w, r.m, r.f or 0.0)
    named = sorted({s for m in mixes.values() for s in m})
    own = tokens.where(F.col("source").isin(named)) if named else tokens.where("false")
    size = {r.source: (r.n, r.t) for r in own.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}  # a row a named source
    everything = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if not size:
        return spark.createDataFrame([], "mix_name string, doc_id long, source string, n_tokens long, uses int")
    shards = {s: min(spec.most_shards, max(1, -(-n // spec.shard_documents))) for s, (n, _) in size.items()}
    count = F.broadcast(spark.createDataFrame(sorted(shards.items()), "source string, shards long"))
    sharded = own.join(count, "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(spec.seed), "doc_id"), F.col("shards")))
    in_shard: dict[str, dict[int, int]] = defaultdict(dict)
    for r in sharded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")).collect():  # at most most_shards a source
        in_shard[r.source][r.shard] = r.t
    passes, rests = [], []
    for mix, sources in sorted(mixes.items()):
        total = max(f for _, _, f in sources.values()) * everything
        block = max(1.0, total / spec.blocks)
        there = {s: v for s, v in sources.items() if s in size}
        seats = sainte_lague({s: w for s, (w, _, _) in there.items()}, int(total // block), {s: int(m * size[s][1] // block) for s, (_, m, _) in there.items()})
        for s, n in seats.items():
            quota, (_, most, _) = n * block, there[s]
            full = min(most, int(quota // size[s][1]))
            rest = 0 if full >= most else int((quota - full * size[s][1]) // block)
            passes.append((mix, s, full))
            for shard, k in sainte_lague(in_shard[s], rest, {i: -int(-t // block) for i, t in in_shard[s].items()}).items():
                if k:
                    rests.append((mix, s, shard, float(k * block)))
    passes = F.broadcast(spark.createDataFrame(passes, "mix_name string, source string, full int"))
    rests = F.broadcast(spark.createDataFrame(rests, "mix_name string, source string, shard long, quota double"))
    rows = sharded.join(passes, "source").join(rests, ["mix_name", "source", "shard"], "left")
    order = Window.partitionBy("mix_name", "source", "shard").orderBy(F.xxhash64(F.lit(spec.seed), "mix_name", "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a document is taken while at least half of it fits
    rows = rows.withColumn("extra", (F.sum("n_tokens").over(order) - F.col("n_tokens") / 2 <= F.coalesce("quota", F.lit(0.0))).cast("int"))
    return rows.select("mix_name", "doc_id", "source", "n_tokens", (F.col("full") + F.col("extra")).cast("int").alias("uses")).where("uses > 0")


def mix_report(documents: DataFrame, targets: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """Per mix and source of the targets: target and reached share, tokens, documents used, most uses, and whether the source is used up."""
    tokens = materialize(token_counts(documents, spec), "tokens")
    used = mix_documents(documents, targets, spec, tokens).groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("n_documents"), F.max("uses").alias("most_uses"))
    goal = targets.where("mix_name is not null and source is not null").groupBy("mix_name", F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"), F.max("size_factor").alias("size_factor"))
    there = tokens.groupBy("source").agg(F.sum("n_tokens").alias("there"))
    every = tokens.agg(F.sum("n_tokens").alias("everything"))
    out = goal.join(used, ["mix_name", "source"], "left").join(there, "source", "left").crossJoin(F.broadcast(every))  # one row
    got = F.coalesce("tokens", F.lit(0))
    whole = F.sum(got).over(Window.partitionBy("mix_name"))  # a row a source of the mix
    return out.select(
        "mix_name", "source", "target_share", "max_repeats",
        got.cast("long").alias("tokens"), F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.round(got / F.when(whole > 0, whole), 6).alias("share"),
        F.round(whole / F.when(F.col("everything") > 0, F.col("everything")), 6).alias("size_reached"),
        (got >= F.coalesce(F.col("there") * F.col("max_repeats"), F.lit(0)) * 0.999).alias("used_up"),
    )
