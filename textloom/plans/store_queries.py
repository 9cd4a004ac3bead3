"""Queries of levels, stored tables, events and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import stats as A
from textloom.operators import levels as V
from textloom.plans.catalogue import query
from textloom.session import materialize, table
from textloom.streaming import streams as R

_AN = "an as (select distinct id, created_at, title, text_sha1, word_count, language, status, ai_share, document_probability, confidence, result_json from analyses where id is not null)"


def _analyses(spark, sf_dir):
    """Whole rows are repeated but for received_at: each once."""
    return table(spark, sf_dir, "analyses").where("id is not null").drop("received_at").distinct()


@query("q_history_topn", f"with {_AN} select id, title, text_sha1, status from an order by id desc limit 50")
def q_history_topn(spark, sf_dir):
    return _analyses(spark, sf_dir).select("id", "title", "text_sha1", "status").orderBy(F.desc("id")).limit(50)


@query("q_upsert_latest", f"with {_AN} select text_sha1, id, created_at, status from (select *, row_number() over (partition by text_sha1 order by created_at desc, id desc) as rn from an where text_sha1 is not null and created_at is not null) where rn = 1")
def q_upsert_latest(spark, sf_dir):
    rows = _analyses(spark, sf_dir).where("text_sha1 is not null and created_at is not null").select("text_sha1", "created_at", "id", "status")
    return V.latest(rows, "text_sha1", "created_at", "id").select("text_sha1", "id", "created_at", "status")


@query("q_insert_if_absent", "select text_sha1, any_value(origin) as origin from (select text_sha1, 'library' as origin from reference_docs union all (select distinct sha1(text), 'new' from eval_items where text is not null and sha1(text) not in (select text_sha1 from reference_docs))) group by text_sha1")
def q_insert_if_absent(spark, sf_dir):
    there = table(spark, sf_dir, "reference_docs").select("text_sha1", F.lit("library").alias("origin"))
    new = table(spark, sf_dir, "eval_items").where("text is not null").select(F.sha1("text").alias("text_sha1"), F.lit("new").alias("origin"))
    return V.insert_if_absent(there, new, "text_sha1")


@query("q_delete_keys", f"with {_AN} select id, status from an where id not in (select id from an where status = 'insufficient_text')")
def q_delete_keys(spark, sf_dir):
    a = _analyses(spark, sf_dir).select("id", "status")
    return V.delete_keys(a, a.where("status = 'insufficient_text'").select("id").distinct(), "id")


@query("q_semi_join", f"with {_AN} select id, text_sha1 from an where text_sha1 in (select sha1(text) from eval_items)")
def q_semi_join(spark, sf_dir):
    items = table(spark, sf_dir, "eval_items").where("text is not null").select(F.sha1("text").alias("text_sha1"))
    return _analyses(spark, sf_dir).select("id", "text_sha1").join(items, "text_sha1", "left_semi")


@query("q_result_json", f"""with {_AN}, j as (select id, case when json_valid(result_json) then result_json end as j from an) select id, try_cast(json_extract_string(j, '$.words') as int) as words, json_extract_string(j, '$.category') as category, round(try_cast(json_extract_string(j, '$.flags') as double), 5) as flags from j""")
def q_result_json(spark, sf_dir):
    from textloom.sources.jsonrows import clean_number, parsed

    a = _analyses(spark, sf_dir).select("id", parsed(F.col("result_json"), "words int, category string, flags double").alias("j"))
    return a.select("id", "j.words", "j.category", clean_number(F.col("j.flags")).alias("flags"))


@query("q_evidence_level", f"with {_AN} select case when word_count < 75 then 'insufficient' when word_count < 150 then 'low' when word_count < 300 then 'moderate' when word_count is not null then 'reliable' end as level, status, count(*) as n from an group by 1, 2")
def q_evidence_level(spark, sf_dir):
    return _analyses(spark, sf_dir).groupBy(V.evidence_level(F.col("word_count")).alias("level"), "status").agg(F.count("*").alias("n"))


@query("q_heat_level", f"with {_AN} select id, case when p < 0.2 then 'very low' when p < 0.4 then 'low' when p < 0.6 then 'medium' when p < 0.8 then 'high' when p is not null then 'very high' end as level from (select id, document_probability as p from an)")
def q_heat_level(spark, sf_dir):
    return _analyses(spark, sf_dir).select("id", V.heat_level(F.col("document_probability")).alias("level"))


@query("q_category", f"with {_AN} select id, case when coalesce(word_count < 30, false) or confidence < 0.35 or ai_share is null then 'Unknown' when ai_share < 0.15 then 'Human' when ai_share < 0.5 then 'Human-assisted' when ai_share < 0.85 then 'AI-assisted' else 'AI' end as category from an")
def q_category(spark, sf_dir):
    return _analyses(spark, sf_dir).select("id", V.category(F.col("ai_share"), F.col("confidence"), F.coalesce(F.col("word_count") < 30, F.lit(False))).alias("category"))


_LR = "case when wc < 50 then wc * 0.3 / 50 when wc < 100 then 0.3 + (wc - 50) * 0.2 / 50 when wc < 250 then 0.5 + (wc - 100) * 0.3 / 150 when wc < 500 then 0.8 + (wc - 250) * 0.15 / 250 when wc < 1000 then 0.95 + (wc - 500) * 0.05 / 500 when wc is not null then 1.0 end"


@query("q_confidence", f"""with {_AN}, x as (select id, word_count as wc, greatest(0.0, least(1.0, 1 - abs(document_probability - ai_share) / 2 / 0.35)) as ag, confidence as cov from an where document_probability is not null and ai_share is not null and confidence is not null), y as (select *, {_LR} as lr from x)
select id, round(lr, 6) as length_reliability, round(ag, 6) as agreement, round(lr * (0.6 + 0.4 * ag) * (0.5 + 0.5 * cov * cov * cov) * (0.7 + 0.3 * 1.0), 6) as overall, case when lr * (0.5 + 0.5 * ag) < 0.35 then 'Low' when lr * (0.5 + 0.5 * ag) < 0.65 then 'Medium' when lr is not null then 'High' end as sentence_level from y""")
def q_confidence(spark, sf_dir):
    a = _analyses(spark, sf_dir).where("document_probability is not null and ai_share is not null and confidence is not null")
    lr = V.length_reliability(F.col("word_count"))
    ag = V.agreement(F.array("document_probability", "ai_share"), F.array(F.lit(1.0), F.lit(1.0)))
    return a.select("id", F.round(lr, 6).alias("length_reliability"), F.round(ag, 6).alias("agreement"), F.round(V.overall_confidence(lr, ag, F.col("confidence"), F.lit(1.0)), 6).alias("overall"), V.sentence_confidence(F.col("word_count"), ag).alias("sentence_level"))


@query("q_burst_events", "with g as (select user_id, epoch_us(ts - lag(ts) over (partition by user_id order by ts, event_id)) / 1e6 as gap from events where user_id is not null and ts is not null) select user_id, count(gap) as n_gaps, round(case when count(gap) >= 2 and stddev_pop(gap) + avg(gap) > 0 then (stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + avg(gap)) end, 6) as burstiness from g group by user_id".replace("epoch_us(ts - lag(ts) over (partition by user_id order by ts, event_id))", "(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id))"))
def q_burst_events(spark, sf_dir):
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    g = e.select("user_id", ((F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))) / 1e6).alias("gap"))
    return g.groupBy("user_id").agg(F.count("gap").alias("n_gaps"), F.round(A.burst(F.col("gap")), 6).alias("burstiness"))


@query("q_stream_tumbling", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2")
def q_stream_tumbling(spark, sf_dir):
    return R.run_once(R.tumbling(R.read_events(spark, sf_dir), "1 hour"), "tumbling", "complete")


@query("q_stream_session", "with g as (select user_id, ts, value, case when lag(ts) over w is null or ts - lag(ts) over w >= interval '30 minutes' then 1 else 0 end as new from events where ts is not null and user_id is not null window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n, round(sum(value), 4) as total from s group by user_id, k")
def q_stream_session(spark, sf_dir):
    return R.run_once(R.sessions(R.read_events(spark, sf_dir), "30 minutes"), "sessions", "complete")


@query("q_stream_dedup", "select event_type, count(distinct event_id) as n from events where ts is not null group by 1")
def q_stream_dedup(spark, sf_dir):
    return R.run_once(R.first_seen(R.read_events(spark, sf_dir), "event_id"), "dedup", "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("q_stream_drift", "with w as (select time_bucket(interval '6 hours', ts) as start, count(*) as n, avg(value) as m from events where ts is not null group by 1) select start, n, round(m - lag(m) over (order by start), 6) as drift from w")
def q_stream_drift(spark, sf_dir):
    return R.window_drift(R.run_once(R.tumbling(R.read_events(spark, sf_dir), "6 hours", by=[]), "drift", "complete"))
