"""Splits that keep related records together (problem 4).

Records of one group form a component.  Components of the same size and label
profile (and main domain) are bundled; a min-cost flow with deviation costs
gives each stratum's rows to the splits; the flow is rounded to whole
components, from the largest sizes down, each level making up for the rounding
of those before; members of a bundle are then told apart by hash order.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.session import materialize


@dataclass(frozen=True)
class SplitSpec:
    """exact_size: sizes up to which a bundle holds one size and label count.

    Beyond, sizes are binned in steps of a tenth and label shares in tenths.
    domains: main domains told apart; rarer ones are one.  These bound the
    number of bundles, whatever the number of records.  bucket: components
    that one task ranks.  hot_share: a group of more than this share of all
    records is joined by broadcast (there are at most 1/hot_share).
    """

    exact_size: int = 32
    domains: int = 40
    bucket: int = 20_000
    hot_share: float = 0.005
    stratum_cost: int = 1
    split_cost: int = 10
    seed: str = "splits"


class _Flow:
    """Min-cost flow by successive cheapest paths on a small network."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        k = len(self.to)
        self.to += [b, a]
        self.cap += [cap, 0]
        self.cost += [cost, -cost]
        self.out[a].append(k)
        self.out[b].append(k + 1)
        return k

    def run(self, s: int, t: int) -> None:
        while True:
            dist, via, queue, queued = {s: 0}, {}, [s], {s}
            while queue:
                u = queue.pop(0)
                queued.discard(u)
                for k in self.out[u]:
                    v = self.to[k]
                    if self.cap[k] and dist[u] + self.cost[k] < dist.get(v, 1 << 60):
                        dist[v], via[v] = dist[u] + self.cost[k], k
                        if v not in queued:
                            queue.append(v)
                            queued.add(v)
            if t not in dist:
                return
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            most = min(self.cap[k] for k in path)
            for k in path:
                self.cap[k] -= most
                self.cap[k ^ 1] += most


def flow_shares(supply: dict, want: dict, splits: list[str], spec: SplitSpec) -> dict:
    """Rows of each stratum for each split at the least cost.

    supply: rows a stratum.  want: rows wanted a (stratum, split).  A row
    beyond what its stratum wants in a split costs ``stratum_cost``, one
    beyond what the split wants in all ``split_cost``.
    """
    flow, strata, n = _Flow(), sorted(supply), len(splits)
    s, t = 0, 1
    split_node = {k: 2 + i for i, k in enumerate(splits)}
    given = {}
    for i, x in enumerate(strata):
        node = 2 + n + i
        flow.arc(s, node, supply[x], 0)
        for k in splits:
            quota = max(0, round(want[x, k]))
            given[x, k] = (flow.arc(node, split_node[k], quota, 0), quota, flow.arc(node, split_node[k], supply[x], spec.stratum_cost))
    total = sum(supply.values())
    for k in splits:
        flow.arc(split_node[k], t, max(0, round(sum(want[x, k] for x in strata))), 0)
        flow.arc(split_node[k], t, total, spec.split_cost)
    flow.run(s, t)
    return {(x, k): flow.cap[a ^ 1] + flow.cap[b ^ 1] for (x, k), (a, _, b) in given.items()}


def bundle_quotas(bundles: list[tuple], shares: dict[str, float], spec: SplitSpec) -> dict:
    """Components of each bundle for each split, as whole numbers.

    bundles: (bundle, stratum, components, rows).  Level by level of size
    (powers of two, largest first) the flow is solved for what the level
    should get plus what former levels owe, and rounded bundle by bundle.
    """
    splits = sorted(shares)
    whole = sum(shares.values()) or 1.0
    share = {k: shares[k] / whole for k in splits}
    levels = defaultdict(list)
    for b in sorted(bundles, key=lambda b: (-b[3] / b[2], str(b[0]))):
        levels[int(b[3] / b[2]).bit_length()].append(b)
    owed: dict = defaultdict(float)
    out = {}
    for level in sorted(levels, reverse=True):
        supply: dict = defaultdict(int)
        for _, stratum, _, rows in levels[level]:
            supply[stratum] += rows
        want = {(x, k): supply[x] * share[k] + owed[x, k] for x in supply for k in splits}
        given = flow_shares(supply, want, splits, spec)
        debt: dict = defaultdict(float)
        for name, x, n, rows in levels[level]:
            size = rows / n
            ideal = {k: n * given[x, k] / supply[x] + debt[x, k] / size for k in splits}
            got = {k: max(0, int(ideal[k])) for k in splits}
            while sum(got.values()) > n:
                got[max(splits, key=lambda k: (got[k] - ideal[k], got[k]))] -= 1
            for _ in range(n - sum(got.values())):
                got[max(splits, key=lambda k: (ideal[k] - got[k], share[k]))] += 1
            for k in splits:
                debt[x, k] += n * given[x, k] / supply[x] * size - got[k] * size
            out[name] = got
        for x in supply:
            for k in splits:
                # what the stratum was to have, less what it got
                owed[x, k] = want[x, k] - sum(out[b][k] * r / n for b, s, n, r in levels[level] if s == x)
        # what a stratum of this level can't make up is owed by the others of the next
        later = {b[1] for l in levels if l < level for b in levels[l]}
        for k in splits:
            stuck = sum(v for (x, kk), v in owed.items() if kk == k and x not in later)
            for x in [x for (x, kk) in owed if kk == k and x not in later]:
                owed[x, k] = 0.0
            for x in later:
                owed[x, k] += stuck / len(later)
    return out


def components_of(samples: DataFrame) -> DataFrame:
    """(id, g, label, domain), one row a sample; g is the group in small letters without outer spaces, or the sample itself."""
    rows = samples.where("id is not null").select("id", "group_id", "label", "domain").dropDuplicates(["id"])
    g = F.lower(F.trim("group_id"))
    return rows.select("id", F.when(F.coalesce(g, F.lit("")) != "", F.concat(F.lit("g:"), g)).otherwise(F.concat(F.lit("i:"), F.col("id"))).alias("g"), F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("domain", F.lit("")).alias("domain"))


def assign_splits(samples: DataFrame, targets: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """(plan_name, id, split): one split a sample and plan.

    samples: id, group_id, label, domain; targets: plan_name, split, share.
    All samples of a group share a split; a null or blank group_id is a group
    of its own; null labels and domains are values of their own; delivered
    copies count once.  Shares are taken relative to their sum.  A plan
    without positive shares has no rows; no samples, no rows.
    """
    spark = samples.sparkSession
    rows = components_of(samples)
    by_domain = rows.groupBy("g", "domain").agg(F.count("*").alias("m"), F.count_if(F.col("label") == 1).alias("m1"))
    parts = by_domain.groupBy("g").agg(F.sum("m").alias("n"), F.sum("m1").alias("n1"), F.max_by("domain", F.struct("m", "domain")).alias("domain"))
    log_bin = F.round(F.log(1.1, F.col("n"))).cast("int")
    exact = F.col("n") <= spec.exact_size
    comps = materialize(
        parts.select("g", "n", "n1", "domain", F.when(exact, F.col("n")).otherwise(F.lit(1000) + log_bin).cast("int").alias("size_bin"), F.when(exact, F.col("n1")).otherwise(F.round(F.col("n1") * 10 / F.col("n"))).cast("int").alias("label_bin"), F.abs(F.xxhash64(F.lit(spec.seed), "g") % (1 << 40)).alias("h")),
        "groups",
    )
    domains = [r.domain for r in comps.groupBy("domain").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "domain").limit(spec.domains).collect()]
    named = comps.withColumn("domain", F.when(F.col("domain").isin(domains), F.col("domain")).otherwise(F.lit("other"))) if domains else comps
    bundle = F.concat_ws("|", "domain", F.col("size_bin").cast("string"), F.col("label_bin").cast("string"))
    named = named.withColumn("bundle", bundle)
    # at most domains * (exact_size ** 2 / 2 + bins * 11) rows
    found = named.groupBy("bundle", "domain").agg(F.count("*").alias("c"), F.sum("n").alias("rows"), F.sum("n1").alias("ones")).collect()
    plans: dict[str, dict[str, float]] = defaultdict(dict)
    for r in targets.where("plan_name is not null and split is not null and share > 0").groupBy("plan_name", "split").agg(F.max("share").alias("share")).collect():  # a row a plan and split
        plans[r.plan_name][r.split] = r.share
    out_schema = f"plan_name string, id {dict(samples.dtypes)['id']}, split string"
    if not found or not plans:
        return spark.createDataFrame([], out_schema)
    bundles = [(r.bundle, (r.domain, 0 if r.ones * 4 < r.rows else 2 if r.ones * 4 > 3 * r.rows else 1), r.c, r.rows) for r in found]
    quotas = []
    for plan, shares in sorted(plans.items()):
        for name, got in bundle_quotas(bundles, shares, spec).items():
            cum, cuts = 0, []
            for k in sorted(got):
                cum += got[k]
                cuts.append(cum)
            quotas.append((plan, name, cuts, sorted(got)))
    quotas = F.broadcast(spark.createDataFrame(quotas, "plan_name string, bundle string, cuts array<long>, splits array<string>"))
    # ranks in two steps: within a bucket of hashes, and by the buckets before
    width = F.broadcast(spark.createDataFrame([(r.bundle, max(1, -(-r.c // spec.bucket))) for r in found], "bundle string, buckets long"))
    placed = named.join(width, "bundle").withColumn("bucket", F.floor(F.col("h") * F.col("buckets") / F.lit(float(1 << 40))))
    before = placed.groupBy("bundle", "bucket").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.partitionBy("bundle").orderBy("bucket")) - F.col("k")).drop("k")
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("bundle", "bucket").orderBy("h", "g")) - 1).join(before, ["bundle", "bucket"])
    rank = F.col("r") + F.col("before")
    split = F.element_at("splits", (F.size(F.filter("cuts", lambda x: x <= rank)) + 1).cast("int"))
    told = ranked.join(quotas, "bundle").select("g", "n", "plan_name", split.alias("split")).groupBy("g").agg(F.max("n").alias("n"), F.collect_list(F.struct("plan_name", "split")).alias("s"))  # a row a plan, few
    told = materialize(told, "group-splits")
    total = sum(r.rows for r in found)
    hot = F.broadcast(told.where(F.col("n") > max(100, total * spec.hot_share)).select("g", "s"))
    rest = told.where(F.col("n") <= max(100, total * spec.hot_share)).select("g", "s")
    ids = rows.select("id", "g")
    both = ids.join(hot, "g").unionByName(ids.join(hot.select("g"), "g", "left_anti").join(rest, "g"))
    return both.select("id", F.inline("s")).select("plan_name", "id", "split")


def split_report(samples: DataFrame, targets: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """Per plan and split: rows, share, target, difference, groups, share of label 1, and the largest difference of a domain's share from the target."""
    rows = components_of(samples)
    got = assign_splits(samples, targets, spec).join(rows, "id")
    per = got.groupBy("plan_name", "split", "domain").agg(F.count("*").alias("m"), F.count_if(F.col("label") == 1).alias("m1"), F.approx_count_distinct("g", 0.01).alias("groups"))
    in_plan = Window.partitionBy("plan_name", "domain")
    per = per.withColumn("domain_share", F.col("m") / F.sum("m").over(in_plan))
    goal = targets.groupBy("plan_name", "split").agg(F.max("share").alias("target"))
    out = per.join(F.broadcast(goal), ["plan_name", "split"]).groupBy("plan_name", "split", "target").agg(F.sum("m").alias("n_samples"), F.sum("m1").alias("n_label_1"), F.max(F.abs(F.col("domain_share") - F.col("target"))).alias("domain_off"))
    share = F.col("n_samples") / F.sum("n_samples").over(Window.partitionBy("plan_name"))
    return out.select("plan_name", "split", "target", "n_samples", F.round(share, 6).alias("share"), F.round(share - F.col("target"), 6).alias("off"), F.round(F.col("n_label_1") / F.col("n_samples"), 6).alias("label_1_share"), F.round("domain_off", 6).alias("domain_off"))
