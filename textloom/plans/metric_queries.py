"""Queries of the evaluation operators, over samples scored by the analyses of their texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import metrics as M
from textloom.plans.catalogue import query
from textloom.session import table

#: The last good analysis of each text, then one row a sample.
_SCORED = """lastgood as (select text_sha1, arg_max(document_probability, (created_at, id)) as p, arg_max(ai_share, (created_at, id)) as share, arg_max(confidence, (created_at, id)) as conf, arg_max(word_count, (created_at, id)) as wc
 from analyses where text_sha1 is not null and status = 'ok' and document_probability is not null and created_at is not null and id is not null group by text_sha1),
one as (select * exclude (rn) from (select *, row_number() over (partition by id order by ingested_at) as rn from samples where id is not null and text is not null) where rn = 1),
sc as (select one.id, label as y, p, share, conf, coalesce(domain, 'none') as domain, generator, source_dataset, eval_set, split, writer_group, coalesce(nullif(lower(trim(group_id)), ''), one.id) as g, ai_fraction, hybrid_class, n_words, wc from one join lastgood on text_sha1 = sha1(text) where label is not null)"""
_W = "wt as (select *, count(*) over () / (2.0 * count(*) over (partition by y)) as w from sc)"


def scored(spark, sf_dir):
    """(id, y, p, ...): label and last good score of every sample that has one.

    Analyses are reduced to one row a text before the join, so that the text
    of a tenth of all analyses is one row in it.
    """
    a = table(spark, sf_dir, "analyses").where("text_sha1 is not null and status = 'ok' and document_probability is not null and created_at is not null and id is not null")
    last = a.groupBy("text_sha1").agg(F.max(F.struct("created_at", "id", "document_probability", "ai_share", "confidence", "word_count")).alias("m"))
    last = last.select("text_sha1", F.col("m.document_probability").alias("p"), F.col("m.ai_share").alias("share"), F.col("m.confidence").alias("conf"), F.col("m.word_count").alias("wc"))
    s = table(spark, sf_dir, "samples").where("id is not null and text is not null and label is not null")
    s = s.select("id", "label", "domain", "generator", "source_dataset", "eval_set", "split", "writer_group", "group_id", "ai_fraction", "hybrid_class", "n_words", F.sha1("text").alias("text_sha1")).dropDuplicates(["id"])
    g = F.coalesce(F.nullif(F.lower(F.trim("group_id")), F.lit("")), F.col("id"))
    return s.join(last, "text_sha1").select("id", F.col("label").alias("y"), "p", "share", "conf", F.coalesce("domain", F.lit("none")).alias("domain"), "generator", "source_dataset", "eval_set", "split", "writer_group", g.alias("g"), "ai_fraction", "hybrid_class", "n_words", "wc")


@query("q_scored", f"with {_SCORED} select id, y, p, domain from sc")
def q_scored(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "y", "p", "domain")


def _threshold_sql(by: str) -> str:
    return f"""with {_SCORED}, c as (select {by}, count(*) as n, count(*) filter (where y = 1 and p >= 0.5) as tp, count(*) filter (where y = 0 and p < 0.5) as tn, count(*) filter (where y = 0 and p >= 0.5) as fp, count(*) filter (where y = 1 and p < 0.5) as fn,
 avg(case when y = 1 then (1 - p) * (1 - p) end) as b1, avg(case when y = 0 then p * p end) as b0 from sc group by {by})
select {by}, n, tp, tn, fp, fn, round((tp + tn) / n, 6) as accuracy, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) as balanced_accuracy, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1,
 round(fp / nullif(fp + tn, 0), 6) as fpr, round(fn / nullif(fn + tp, 0), 6) as fnr, round((b1 + b0) / 2, 6) as brier from c"""


@query("q_binary_metrics", _threshold_sql("'all'::varchar as part, ").replace("group by 'all'::varchar as part, ", "group by 1").replace("select 'all'::varchar as part, , count", "select 'all'::varchar as part, count").replace("select 'all'::varchar as part, , n", "select part, n"))
def q_binary_metrics(spark, sf_dir):
    return M.threshold_metrics(scored(spark, sf_dir).withColumn("part", F.lit("all")), ["part"])


@query("q_metrics_by_domain", _threshold_sql("domain"))
def q_metrics_by_domain(spark, sf_dir):
    return M.threshold_metrics(scored(spark, sf_dir), ["domain"])


@query("q_metrics_by_generator", _threshold_sql("generator"))
def q_metrics_by_generator(spark, sf_dir):
    return M.threshold_metrics(scored(spark, sf_dir), ["generator"])


def _ranking_sql(by: str, source: str = "sc", value: str = "p") -> str:
    return f"""c as (select {by}, round({value}, 6) as p, count(*) filter (where y = 1)::double as pos, count(*) filter (where y = 0)::double as neg from {source} where y is not null and {value} is not null group by {by}, round({value}, 6)),
v as (select *, sum(pos) over d as tp, sum(neg) over d as fp, sum(pos) over (partition by {by}) as np, sum(neg) over (partition by {by}) as nn from c window d as (partition by {by} order by p desc rows unbounded preceding)),
r as (select *, tp / nullif(np, 0) as tpr, fp / nullif(nn, 0) as fpr from v),
a as (select {by}, sum(neg * (tp - pos / 2)) / nullif(max(np) * max(nn), 0) as roc, sum(pos / nullif(np, 0) * tp / (tp + fp)) as pr, max(np) > 0 and max(nn) > 0 as ok,
 max({{'f': fpr, 't': tpr}}) filter (where fpr <= 0.01) as u1, min({{'f': fpr, 't': tpr}}) filter (where fpr > 0.01) as o1, max({{'f': fpr, 't': tpr}}) filter (where fpr <= 0.05) as u5, min({{'f': fpr, 't': tpr}}) filter (where fpr > 0.05) as o5 from r group by {by}),
rk as (select {by}, round(roc, 6) as roc_auc, case when ok then round(pr, 6) end as pr_auc,
 case when ok then round(case when o1 is null then coalesce(u1.t, 0) else coalesce(u1.t, 0) + (0.01 - coalesce(u1.f, 0)) / (o1.f - coalesce(u1.f, 0)) * (o1.t - coalesce(u1.t, 0)) end, 6) end as tpr_at_1,
 case when ok then round(case when o5 is null then coalesce(u5.t, 0) else coalesce(u5.t, 0) + (0.05 - coalesce(u5.f, 0)) / (o5.f - coalesce(u5.f, 0)) * (o5.t - coalesce(u5.t, 0)) end, 6) end as tpr_at_5 from a)"""


@query("q_roc_pr_by_domain", f"with {_SCORED}, {_ranking_sql('domain')} select * from rk")
def q_roc_pr_by_domain(spark, sf_dir):
    return M.ranking_metrics(scored(spark, sf_dir), ["domain"])


@query("q_roc_pr_by_source", f"with {_SCORED}, {_ranking_sql('source_dataset')} select * from rk")
def q_roc_pr_by_source(spark, sf_dir):
    return M.ranking_metrics(scored(spark, sf_dir), ["source_dataset"])


@query("q_wilson", f"""with {_SCORED}, c as (select coalesce(eval_set, split, 'none') as place, count(*) filter (where y = 0) as n, count(*) filter (where y = 0 and p >= 0.5) as k from sc group by 1), x as (select *, 1.959963984540054 as z, nullif(n, 0)::double as m from c)
select place, n, k, round(greatest(0.0, (k / m + z * z / (2 * m)) / (1 + z * z / m) - z / (1 + z * z / m) * sqrt(k / m * (1 - k / m) / m + z * z / (4 * m * m))), 6) as low,
 case when m is not null then round(least(1.0, (k / m + z * z / (2 * m)) / (1 + z * z / m) + z / (1 + z * z / m) * sqrt(k / m * (1 - k / m) / m + z * z / (4 * m * m))), 6) end as high from x""".replace("round(greatest(0.0,", "case when m is not null then round(greatest(0.0,").replace(", 6) as low", ", 6) end as low"))
def q_wilson(spark, sf_dir):
    c = scored(spark, sf_dir).groupBy(F.coalesce("eval_set", "split", F.lit("none")).alias("place")).agg(F.count_if(F.col("y") == 0).alias("n"), F.count_if((F.col("y") == 0) & (F.col("p") >= 0.5)).alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    has = F.col("n") > 0
    return c.select("place", "n", "k", F.when(has, F.round(low, 6)).alias("low"), F.when(has, F.round(high, 6)).alias("high"))


@query("q_brier_logloss", f"with {_SCORED}, {_W}, x as (select *, least(greatest(p, 1e-6), 1 - 1e-6) as q from wt) select source_dataset, round(sum(w * (p - y) ** 2) / sum(w), 6) as brier, round(-sum(w * (y * ln(q) + (1 - y) * ln(1 - q))) / sum(w), 6) as log_loss from x group by source_dataset")
def q_brier_logloss(spark, sf_dir):
    return M.loss(M.balanced_weights(scored(spark, sf_dir), []), ["source_dataset"])


_BINS = "b as (select source_dataset, least(greatest(floor(p * 10), 0), 9)::int as bin, count(*) as n, sum(w * p) / sum(w) as mean_p, sum(w * y) / sum(w) as share_1, sum(w) as weight from wt group by 1, 2), sp as (select distinct source_dataset, unnest(range(0, 10))::int as bin from b)"


@query("q_reliability", f"with {_SCORED}, {_W}, {_BINS} select sp.source_dataset, sp.bin, coalesce(n, 0) as n, round(mean_p, 6) as mean_p, round(share_1, 6) as share_1 from sp left join b on sp.source_dataset = b.source_dataset and sp.bin = b.bin")
def q_reliability(spark, sf_dir):
    r = M.reliability(M.balanced_weights(scored(spark, sf_dir), []), ["source_dataset"])
    return r.select("source_dataset", "bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("share_1", 6).alias("share_1"))


@query("q_ece", f"with {_SCORED}, {_W}, {_BINS} select source_dataset, round(sum(weight * abs(mean_p - share_1)) / sum(weight), 6) as ece from b group by 1")
def q_ece(spark, sf_dir):
    return M.expected_calibration_error(M.balanced_weights(scored(spark, sf_dir), []), ["source_dataset"])


def _quantile_sql(name: str, source: str, qs: str) -> str:
    return f"""{name}c as (select round(v, 6) as v, sum(w)::double as w from ({source}) group by 1), {name}s as (select v, sum(w) over (order by v rows unbounded preceding) / sum(w) over () as share from {name}c where w > 0),
{name}q as (select unnest({qs}) as q), {name}b as (select q, max({{'s': share, 'v': v}}) filter (where share <= q) as u, min({{'s': share, 'v': v}}) filter (where share > q) as o from {name}s cross join {name}q group by q),
{name} as (select q, round(case when u is null then o.v when o is null then u.v else u.v + (q - u.s) / (o.s - u.s) * (o.v - u.v) end, 6) as value from {name}b)"""


@query("q_weighted_quantile", f"with {_SCORED}, {_quantile_sql('z', 'select p as v, n_words as w from sc where n_words is not null', '[0.05, 0.25, 0.5, 0.75, 0.95]')} select q::double as q, value from z")
def q_weighted_quantile(spark, sf_dir):
    return M.weighted_quantiles(scored(spark, sf_dir).where("n_words is not null"), [], "p", "n_words", [0.05, 0.25, 0.5, 0.75, 0.95])


@query("q_bands", f"with {_SCORED}, {_quantile_sql('h', 'select p as v, 1 as w from sc where y = 0', '[0.95]')}, {_quantile_sql('l', 'select p as v, 1 as w from sc where y = 1', '[0.05]')} select greatest(0.5, least(0.9, h.value)) as t_high, greatest(0.1, least(0.5, l.value)) as t_low from h cross join l")
def q_bands(spark, sf_dir):
    return M.bands(scored(spark, sf_dir))


@query("q_share", f"with {_SCORED} select domain, round(sum(share * n_words) / sum(n_words), 6) as raw_share, count(*) as n from sc where n_words is not null and share is not null group by domain")
def q_share(spark, sf_dir):
    s = scored(spark, sf_dir).where("n_words is not null and share is not null")
    return s.groupBy("domain").agg(F.round(F.sum(F.col("share") * F.col("n_words")) / F.sum("n_words"), 6).alias("raw_share"), F.count("*").alias("n"))


_CATEGORY = "case when wc < 30 or conf < 0.35 or share is null then 'Unknown' when share < 0.15 then 'Human' when share < 0.5 then 'Human-assisted' when share < 0.85 then 'AI-assisted' else 'AI' end"


@query("q_confusion", f"with {_SCORED} select hybrid_class, {_CATEGORY} as category, count(*) as n from sc group by 1, 2")
def q_confusion(spark, sf_dir):
    from textloom.operators.levels import category

    return scored(spark, sf_dir).groupBy("hybrid_class", category(F.col("share"), F.col("conf"), F.col("wc") < 30).alias("category")).agg(F.count("*").alias("n"))


@query("q_confidence_bins", f"with {_SCORED} select case when conf < 0.35 then 'Low' when conf < 0.65 then 'Medium' when conf is not null then 'High' end as level, count(*) as n, round(avg((case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end)), 6) as accuracy from sc group by 1")
def q_confidence_bins(spark, sf_dir):
    c = F.col("conf")
    level = F.when(c < 0.35, "Low").when(c < 0.65, "Medium").when(c.isNotNull(), "High")
    return scored(spark, sf_dir).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.round(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")), 6).alias("accuracy"))


@query("q_mae_corr", f"with {_SCORED} select count(*) as n, round(avg(abs(share - ai_fraction)), 6) as mae, round(corr(share, ai_fraction), 6) as correlation from sc where share is not null and ai_fraction is not null")
def q_mae_corr(spark, sf_dir):
    s = scored(spark, sf_dir).where("share is not null and ai_fraction is not null")
    return s.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("share") - F.col("ai_fraction"))), 6).alias("mae"), F.round(F.corr("share", "ai_fraction"), 6).alias("correlation"))


@query("q_detector_correlation", f"with {_SCORED} select 'p' as a, 'share' as b, round(corr(p, share), 6) as r from sc union all select 'p', 'conf', round(corr(p, conf), 6) from sc union all select 'share', 'conf', round(corr(share, conf), 6) from sc")
def q_detector_correlation(spark, sf_dir):
    s = scored(spark, sf_dir)
    pairs = [("p", "share"), ("p", "conf"), ("share", "conf")]
    one = s.agg(*[F.round(F.corr(a, b), 6).alias(f"{a}_{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("r")) for a, b in pairs])))


@query("q_disagreement", f"with {_SCORED}, x as (select *, round(sqrt(((p - (p + share) / 2) ** 2 + (share - (p + share) / 2) ** 2) / 2), 6) as spread from sc where share is not null), m as (select quantile_cont(spread, 0.5) as med from x) select spread > med as disagree, count(*) as n, round(avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end), 6) as accuracy, round(max(spread), 6) as widest from x cross join m group by 1")
def q_disagreement(spark, sf_dir):
    s = scored(spark, sf_dir).where("share is not null")
    mean = (F.col("p") + F.col("share")) / 2
    s = s.withColumn("spread", F.round(F.sqrt(((F.col("p") - mean) ** 2 + (F.col("share") - mean) ** 2) / 2), 6))
    med = s.groupBy("spread").agg(F.count("*").alias("c")).agg(F.percentile("spread", 0.5, F.col("c")).alias("med"))
    return s.crossJoin(F.broadcast(med)).groupBy((F.col("spread") > F.col("med")).alias("disagree")).agg(F.count("*").alias("n"), F.round(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")), 6).alias("accuracy"), F.round(F.max("spread"), 6).alias("widest"))


@query("q_bootstrap_auc", f"""with {_SCORED}, x as (select g, round(p, 6) as p, count(*) filter (where y = 1) as n1, count(*) filter (where y = 0) as n0 from sc group by 1, 2), r as (select *, unnest(range(1, 501)) as rep from x),
u as (select *, ('0x' || substr(md5('7|' || g || '|' || rep), 1, 15))::bigint / 1152921504606846976.0 as u from r), k as (select *, case when u < 0.36787944 then 0 when u < 0.73575888 then 1 when u < 0.9196986 then 2 when u < 0.98101184 then 3 when u < 0.99634015 then 4 when u < 0.99940582 then 5 else 6 end as k from u),
c as (select rep, p, sum(k * n1)::double as pos, sum(k * n0)::double as neg from k where k > 0 group by 1, 2), v as (select *, sum(pos) over (partition by rep order by p desc rows unbounded preceding) as tp from c), a as (select rep, sum(neg * (tp - pos / 2)) / nullif(sum(pos) * sum(neg), 0) as auc from v group by rep)
select round(avg(auc), 6) as auc, round(quantile_cont(auc, 0.025), 6) as low, round(quantile_cont(auc, 0.975), 6) as high, count(auc) as n_valid from a where auc is not null""")
def q_bootstrap_auc(spark, sf_dir):
    return M.bootstrap_auc(scored(spark, sf_dir), "g")


@query("q_fp_audit", f"with {_SCORED}, r as (select count(*) filter (where y = 0 and p >= 0.5) / nullif(count(*) filter (where y = 0), 0) as ref from sc where eval_set is null) select eval_set, count(*) filter (where y = 0) as n_human, count(*) filter (where y = 0 and p >= 0.5) as flagged, round(count(*) filter (where y = 0 and p >= 0.5) / nullif(count(*) filter (where y = 0), 0), 6) as fpr, round(count(*) filter (where y = 0 and p >= 0.5) / nullif(count(*) filter (where y = 0), 0) / nullif(any_value(ref), 0), 6) as ratio, round(avg(case when share >= 0.5 then 1.0 when share is not null then 0.0 end), 6) as majority_share from sc cross join r where eval_set is not null group by eval_set")
def q_fp_audit(spark, sf_dir):
    s = scored(spark, sf_dir)
    n, k = F.count_if(F.col("y") == 0), F.count_if((F.col("y") == 0) & (F.col("p") >= 0.5))
    div = lambda a, b: a / F.when(b > 0, b)
    ref = s.where("eval_set is null").agg(div(k, n).alias("ref"))
    per = s.where("eval_set is not null").groupBy("eval_set").agg(n.alias("n_human"), k.alias("flagged"), F.round(F.avg((F.col("share") >= 0.5).cast("double")), 6).alias("majority_share"))
    rate = div(F.col("flagged"), F.col("n_human"))
    return per.crossJoin(F.broadcast(ref)).select("eval_set", "n_human", "flagged", F.round(rate, 6).alias("fpr"), F.round(rate / F.when(F.col("ref") > 0, F.col("ref")), 6).alias("ratio"), "majority_share")


@query("q_perturbed_vs_reference", f"with {_SCORED}, o as (select g, avg(p) as p0, count(*) as n from sc where eval_set is null group by g) select eval_set, count(*) as n, count(o.g) as n_with_reference, round(avg(p), 6) as mean_p, round(avg(p - p0), 6) as mean_change from sc left join o on sc.g = o.g where eval_set is not null group by eval_set")
def q_perturbed_vs_reference(spark, sf_dir):
    s = scored(spark, sf_dir)
    ref = s.where("eval_set is null").groupBy("g").agg(F.avg("p").alias("p0"))
    rows = s.where("eval_set is not null").join(ref, "g", "left")
    return rows.groupBy("eval_set").agg(F.count("*").alias("n"), F.count("p0").alias("n_with_reference"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.col("p") - F.col("p0")), 6).alias("mean_change"))


@query("q_conservative", f"with {_SCORED}, t as (select round(quantile_cont(p, 0.99), 6) as t from sc where y = 0) select t as threshold, count(*) filter (where y = 0 and p >= t) as false_alarms, round(count(*) filter (where y = 1 and p >= t) / nullif(count(*) filter (where y = 1), 0), 6) as recall from sc cross join t group by t")
def q_conservative(spark, sf_dir):
    s = scored(spark, sf_dir)
    # from counts of scores: as many rows as there are different scores of six digits
    t = s.where("y = 0").groupBy(F.round("p", 6).alias("p")).agg(F.count("*").alias("c")).agg(F.round(F.percentile("p", 0.99, F.col("c")), 6).alias("threshold"))
    over = F.col("p") >= F.col("threshold")
    ones = F.count_if(F.col("y") == 1)
    return s.crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.count_if((F.col("y") == 0) & over).alias("false_alarms"), F.round(F.count_if((F.col("y") == 1) & over) / F.when(ones > 0, ones), 6).alias("recall"))


_LEN = "l as (select least(n_words // 50 * 50, 400) as len, * from sc where n_words is not null)"


@query("q_length_table", f"with {_SCORED}, {_LEN}, {_ranking_sql('len', 'l')}, b as (select max(roc_auc) as best from rk) select len, roc_auc, round(greatest(0.0, max(greatest(0.0, (roc_auc - 0.5) / nullif(best - 0.5, 0))) over (order by len)), 6) as reliability from rk cross join b where roc_auc is not null")
def q_length_table(spark, sf_dir):
    s = scored(spark, sf_dir).where("n_words is not null").withColumn("len", F.least(F.floor(F.col("n_words") / 50) * 50, F.lit(400)))
    auc = M.ranking_metrics(s, ["len"]).where("roc_auc is not null").select("len", "roc_auc")
    best = auc.agg(F.max("roc_auc").alias("best"))
    # one row a length: a single window partition is nine rows
    raw = F.greatest(F.lit(0.0), (F.col("roc_auc") - 0.5) / F.when(F.col("best") != 0.5, F.col("best") - 0.5))
    return auc.crossJoin(F.broadcast(best)).withColumn("r", raw).select("len", "roc_auc", F.round(F.max("r").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)), 6).alias("reliability"))


@query("q_thresholds", f"with {_SCORED}, l as (select domain, least(n_words // 50 * 50, 400) as len, avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end) >= 0.55 as ok from sc where n_words is not null group by 1, 2), a as (select domain, len, bool_and(ok) over (partition by domain order by len rows between current row and unbounded following) as every from l) select domain, min(len) as least from a where every group by domain")
def q_thresholds(spark, sf_dir):
    s = scored(spark, sf_dir).where("n_words is not null").withColumn("len", F.least(F.floor(F.col("n_words") / 50) * 50, F.lit(400)))
    per = s.groupBy("domain", "len").agg((F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")) >= 0.55).alias("ok"))
    return M.threshold_from_suffix(per, ["domain"], "len", "ok")


_LONG = "lg as (select domain, y, unnest(['p', 'share', 'conf', 'n_words']) as feature, unnest([p, share, conf, n_words::double]) as value from sc)"


def _long(spark, sf_dir):
    s = scored(spark, sf_dir)
    names = ["p", "share", "conf", "n_words"]
    return s.select("domain", "y", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names])))


@query("q_shortcut_audit", f"with {_SCORED}, {_LONG}, {_ranking_sql('domain, feature', 'lg', 'value')}, n as (select domain, feature, count(*) as n, count(distinct y) as k from lg where value is not null group by 1, 2) select domain, feature, round(greatest(roc_auc, 1 - roc_auc), 6) as auc, n from rk join n using (domain, feature) where n >= 30 and k = 2 and greatest(roc_auc, 1 - roc_auc) >= 0.6 order by auc desc, domain, feature limit 60")
def q_shortcut_audit(spark, sf_dir):
    return M.feature_audit(_long(spark, sf_dir).withColumnRenamed("value", "p"), least_rows=30, least_auc=0.6)


@query("q_population_stats", f"with {_SCORED}, {_LONG} select feature, y, count(value) as n, round(avg(round(value, 6)), 6) as mean, round(stddev_pop(round(value, 6)), 5) as std, list_transform(quantile_cont(round(value, 6), [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]), lambda v: round(v, 6)) as quantiles from lg where value is not null group by 1, 2 having count(value) >= 5")
def q_population_stats(spark, sf_dir):
    return M.population_stats(_long(spark, sf_dir))


@query("q_percentile_in", f"""with {_SCORED}, s as (select quantile_cont(round(p, 6), [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]) as qs from sc where y = 0), x as (select id, p, list_transform(qs, lambda v: round(v, 6)) as qs from sc cross join s), i as (select *, len(list_filter(qs, lambda v: v <= p)) as i from x)
select id, round(case when i = 0 then 0.0 when i >= 21 then 100.0 else (i - 1 + case when qs[least(i + 1, 21)] > qs[i] then (p - qs[i]) / (qs[least(i + 1, 21)] - qs[i]) else 0.0 end) * 5.0 end, 5) as human_percentile from i""")
def q_percentile_in(spark, sf_dir):
    s = scored(spark, sf_dir)
    stats = M.population_stats(s.select("y", F.lit("p").alias("feature"), F.col("p").alias("value"))).where("y = 0").select("quantiles")
    return s.crossJoin(F.broadcast(stats)).select("id", F.round(M.percentile_in(F.col("p"), F.col("quantiles")), 5).alias("human_percentile"))


@query("q_ab_decision", f"with {_SCORED}, m as (select writer_group, count(*) filter (where y = 0 and p >= 0.5) / nullif(count(*) filter (where y = 0), 0) as fa, count(*) filter (where y = 0 and share >= 0.5) / nullif(count(*) filter (where y = 0), 0) as fb from sc where share is not null group by 1) select round(max(fa) filter (where writer_group = 'non_native'), 6) as fpr_a, round(max(fb) filter (where writer_group = 'non_native'), 6) as fpr_b, coalesce(max(fb) filter (where writer_group = 'non_native') < max(fa) filter (where writer_group = 'non_native'), false) as ship_b from m")
def q_ab_decision(spark, sf_dir):
    s = scored(spark, sf_dir).where("share is not null and writer_group = 'non_native' and y = 0")
    fa, fb = F.avg((F.col("p") >= 0.5).cast("double")), F.avg((F.col("share") >= 0.5).cast("double"))
    return s.agg(F.round(fa, 6).alias("fpr_a"), F.round(fb, 6).alias("fpr_b"), F.coalesce(fb < fa, F.lit(False)).alias("ship_b"))
