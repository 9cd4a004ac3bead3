"""Queries of corpus building: samples, splits, sampling, duplicates, augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.operators import corpus as C
from textloom.operators import sentencetable as S
from textloom.plans import sqlparts as P
from textloom.plans.catalogue import query
from textloom.session import table


def _docs(spark, sf_dir):
    return S.documents(table(spark, sf_dir, "documents"))


def _samples(spark, sf_dir):
    """Delivered copies of a sample differ only in ingested_at: the first one."""
    s = table(spark, sf_dir, "samples").where("id is not null")
    return s.drop("ingested_at").dropDuplicates(["id"])


_S = "sm as (select * exclude (rn) from (select *, row_number() over (partition by id order by ingested_at) as rn from samples where id is not null) where rn = 1)"


@query("q_describe", f"""with {_S} select source_dataset, domain, label, count(*) as n, count(*) filter (where label = 0) as n_human, count(*) filter (where label = 1) as n_ai, round(quantile_cont(n_words, 0.5), 6) as median_words, grouping(domain)::int as all_domains
from sm group by grouping sets ((source_dataset, domain, label), (source_dataset))""")
def q_describe(spark, sf_dir):
    s = _samples(spark, sf_dir).select("source_dataset", "domain", "label", "n_words")
    # grouping sets as a union, so that each level stays a plain aggregate
    agg = [F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("n_human"), F.count_if(F.col("label") == 1).alias("n_ai"), F.round(F.percentile("n_words", 0.5), 6).alias("median_words")]
    fine = s.groupBy("source_dataset", "domain", "label").agg(*agg).withColumn("all_domains", F.lit(0))
    coarse = s.groupBy("source_dataset").agg(*agg).select("source_dataset", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("int").alias("label"), "n", "n_human", "n_ai", "median_words", F.lit(1).alias("all_domains"))
    return fine.unionByName(coarse)


@query("q_eval_set_counts", f"with {_S} select coalesce(eval_set, split, 'none') as place, generator_family, count(*) as n from sm group by 1, 2")
def q_eval_set_counts(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy(F.coalesce("eval_set", "split", F.lit("none")).alias("place"), "generator_family").agg(F.count("*").alias("n"))


@query("q_dataset_version", "select source_dataset, substr(sha1(string_agg(h, chr(10) order by h)), 1, 12) as version, count(*) as n from (select distinct source_dataset, id as h from samples where id is not null) group by source_dataset")
def q_dataset_version(spark, sf_dir):
    from textloom.operators.versions import dataset_version

    return dataset_version(table(spark, sf_dir, "samples"), "source_dataset", "id")


@query("q_distinct_values", f"with {_S} select distinct generator, model_version, domain from sm")
def q_distinct_values(spark, sf_dir):
    return _samples(spark, sf_dir).select("generator", "model_version", "domain").distinct()


@query("q_union_sets", "select 'sample' as kind, count(*) as n, count(label) as n_labelled from samples union all select 'document', count(*), count(label) from documents union all select 'item', count(*), 0 from eval_items")
def q_union_sets(spark, sf_dir):
    s = table(spark, sf_dir, "samples").select(F.lit("sample").alias("kind"), "label")
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), "label")
    e = table(spark, sf_dir, "eval_items").select(F.lit("item").alias("kind"))
    return s.unionByName(d).unionByName(e, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"), F.count("label").alias("n_labelled"))


_KEYED = f"{_S}, k as (select id, label, domain, source_dataset || '|' || coalesce(domain, '') as stratum, coalesce(nullif(lower(trim(group_id)), ''), id) as group_key, eval_set, split, text from sm where source_dataset is not null)"


def _keyed(spark, sf_dir):
    s = _samples(spark, sf_dir).where("source_dataset is not null")
    return s.select("id", "label", "domain", F.concat_ws("|", "source_dataset", F.coalesce("domain", F.lit(""))).alias("stratum"), F.coalesce(F.nullif(F.lower(F.trim("group_id")), F.lit("")), F.col("id")).alias("group_key"), "eval_set", "split", "text")


_SPLIT = f"""{_KEYED}, g as (select group_key, arg_min(stratum, id) as stratum, bool_or(eval_set = 'offdomain') as forced from k group by group_key),
f as (select group_key, stratum, row_number() over (partition by stratum order by md5('7' || group_key), group_key) as rn, count(*) over (partition by stratum) as n from g where not coalesce(forced, false)),
a as (select group_key, stratum, case when rn <= round_even(n * 0.2, 0) then 'test' when rn <= round_even(n * 0.2, 0) + round_even(n * 0.1, 0) then 'calib' else 'train' end as new_split from f union all select group_key, stratum, 'test' from g where forced)"""


def _split(spark, sf_dir):
    return C.group_split(_keyed(spark, sf_dir), 0.2, 0.1, forced=F.coalesce(F.col("eval_set") == "offdomain", F.lit(False))).withColumnRenamed("split", "new_split")


@query("q_group_split", f"with {_SPLIT} select group_key, stratum, new_split from a")
def q_group_split(spark, sf_dir):
    return _split(spark, sf_dir)


@query("q_split_report", f"with {_SPLIT} select stratum, new_split, count(*) as n_samples, count(distinct k.group_key) as n_groups from k join a using (group_key) group by a.stratum, new_split".replace("select stratum, new_split, count", "select a.stratum as stratum, new_split, count"))
def q_split_report(spark, sf_dir):
    rows = _keyed(spark, sf_dir).select("id", "group_key").join(_split(spark, sf_dir), "group_key")
    return rows.groupBy("stratum", "new_split").agg(F.count("*").alias("n_samples"), F.countDistinct("group_key").alias("n_groups"))


@query("q_cap_per_stratum", f"with {_KEYED} select stratum, id from (select *, row_number() over (partition by stratum order by md5('7' || id), id) as rn from k) where rn <= 5")
def q_cap_per_stratum(spark, sf_dir):
    return C.capped(_keyed(spark, sf_dir).select("stratum", "id"), ["stratum"], "id", 5)


@query("q_parity_half", "select id, ('0x' || right(sha1(id), 1))::int % 2 as half from (select distinct id from samples where id is not null)")
def q_parity_half(spark, sf_dir):
    return table(spark, sf_dir, "samples").where("id is not null").select("id").distinct().select("id", C.parity_half(F.col("id")).alias("half"))


@query("q_bernoulli", "select id, ('0x' || substr(md5('7|' || id), 1, 15))::bigint / 1152921504606846976.0 < 0.5 as kept from (select distinct id from samples where id is not null)")
def q_bernoulli(spark, sf_dir):
    return table(spark, sf_dir, "samples").where("id is not null").select("id").distinct().select("id", (C.uniform("id") < 0.5).alias("kept"))


@query("q_class_balanced", f"with {_S}, c as (select label, count(*) as n from sm where label is not null group by label), r as (select id, sm.label, c.n, (select max(n) from c) as most, row_number() over (partition by sm.label order by md5('7' || id), id) as rn from sm join c on c.label = sm.label) select id, label, (most // n + case when rn <= most % n then 1 else 0 end)::int as times from r")
def q_class_balanced(spark, sf_dir):
    return C.class_balanced(_samples(spark, sf_dir).where("label is not null").select("id", "label"), "label", "id")


@query("q_group_folds", f"with {_KEYED} select id, (('0x' || substr(md5('7|' || group_key), 1, 15))::bigint % 5)::int as fold from k")
def q_group_folds(spark, sf_dir):
    return C.group_folds(_keyed(spark, sf_dir).select("id", "group_key"), "group_key", 5).select("id", "fold")


_RANK = "case split when 'train' then 0 when 'calib' then 1 when 'test' then 2 else 3 end"


@query("q_exact_dedup", f"with {_S} select id, split from (select *, row_number() over (partition by sha1(text) order by {_RANK}, id) as n from sm where text is not null) where n = 1")
def q_exact_dedup(spark, sf_dir):
    s = _samples(spark, sf_dir).where("text is not null").select("id", "split", "text")
    return C.exact_dedup(s, {"train": 0, "calib": 1, "test": 2}).select("id", "split")


_SHINGLES = r"""case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: ('0x' || substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 15))::bigint)) else [('0x' || substr(md5(array_to_string(w, ' ')), 1, 15))::bigint] end"""


@query("q_shingles", rf"""with {_S}, x as (select id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w from sm where text is not null), y as (select id, {_SHINGLES} as sh from x)
select id, len(sh) as n_shingles, list_min(sh) as least, list_sum(list_transform(sh, lambda v: v % 1000003))::bigint as check_sum from y""")
def q_shingles(spark, sf_dir):
    sh = _samples(spark, sf_dir).where("text is not null").select("id", "text")
    sh = C.with_shingles(sh)
    return sh.select("id", F.size("sh").alias("n_shingles"), F.array_min("sh").alias("least"), F.aggregate("sh", F.lit(0).cast("long"), lambda a, x: a + x % 1000003).alias("check_sum"))


_NEAR = rf"""x as (select id, split, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w from kp), y as (select id, split, {_SHINGLES} as sh from x), z as (select id, split, len(sh) as n, unnest(sh) as g from y),
p as (select a.id, b.id as t, any_value(a.n) as n, any_value(b.n) as m, count(*) as k from z a join z b using (g) where a.split <> 'train' and b.split = 'train' group by a.id, b.id), nr as (select distinct id from p where k >= 0.5 * (n + m - k))"""


@query("q_dedup_report", rf"""with {_S}, al as (select id, split, text, row_number() over (partition by text order by {_RANK}, id) as n from sm where text is not null and split is not null), kp as (select id, split, text from al where n = 1), {_NEAR}
select al.split, count(*) as n, count(*) filter (where al.n > 1) as exact_removed, count(nr.id) as near_removed from al left join nr on nr.id = al.id group by 1""")
def q_dedup_report(spark, sf_dir):
    return C.dedup_report(_samples(spark, sf_dir), {"train": 0, "calib": 1, "test": 2})


@query("q_neardup_antijoin", rf"""with {_S}, x as (select id, split, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w from sm where text is not null and split is not null), y as (select id, split, {_SHINGLES} as sh from x),
z as (select id, split, len(sh) as n, unnest(sh) as g from y), p as (select a.id, b.id as t, any_value(a.n) as n, any_value(b.n) as m, count(*) as k from z a join z b using (g) where a.split <> 'train' and b.split = 'train' group by a.id, b.id)
select id, split from x where id not in (select id from p where k >= 0.5 * (n + m - k))""")
def q_neardup_antijoin(spark, sf_dir):
    s = _samples(spark, sf_dir).where("text is not null and split is not null").select("id", "split", "text")
    return s.select("id", "split").join(C.near_duplicates_of_train(s), "id", "left_anti")


@query("q_minhash_candidates")
def q_minhash_candidates(spark, sf_dir):
    return C.minhash_candidates(_docs(spark, sf_dir).select("doc_id", "text"))


@query("q_leakage_filter", f"with {_KEYED} select id from k where split = 'test' and group_key not in (select group_key from k where split in ('train', 'calib'))")
def q_leakage_filter(spark, sf_dir):
    k = _keyed(spark, sf_dir).select("id", "group_key", "split")
    seen = k.where(F.col("split").isin("train", "calib")).select("group_key").distinct()
    return k.where("split = 'test'").join(seen, "group_key", "left_anti").select("id")


_GENRE = "case domain " + " ".join(f"when {P.q(k)} then {P.q(v)}" for k, v in L.GENRES.items()) + " else 'unknown' end"


@query("q_genre_lookup", f"with {_S} select {_GENRE} as looked_up, genre, count(*) as n from sm group by 1, 2")
def q_genre_lookup(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy(C.genre(F.col("domain")).alias("looked_up"), "genre").agg(F.count("*").alias("n"))


@query("q_length_augment", f"with {P.SENTS}, n as (select doc_id, sum(len(w))::bigint as n from s group by doc_id having sum(len(w)) >= 150), g as (select doc_id, n, floor(50 + ('0x' || substr(md5('7|' || doc_id), 1, 15))::bigint / 1152921504606846976.0 * (n * 0.7 - 50))::bigint as goal from n), c as (select s.*, goal, sum(len(w)) over (partition by s.doc_id order by idx) as cum from s join g on g.doc_id = s.doc_id), t as (select doc_id, any_value(goal) as goal, sum(len(w))::bigint as n_words, string_agg(s, ' ' order by idx) as text from c where cum - len(w) < goal group by doc_id) select doc_id, goal, n_words, md5(text) as cut from t where n_words >= 50")
def q_length_augment(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return C.length_augment(S.sentence_table(d), d).select("doc_id", "goal", "n_words", F.md5("text").alias("cut"))


@query("q_short_sets", f"with {P.SENTS}, l as (select unnest([50, 100, 900]) as most), c as (select s.*, most, sum(len(w)) over (partition by doc_id, most order by idx) as cum from s cross join l) select doc_id, most, sum(len(w))::bigint as n_words, md5(string_agg(s, ' ' order by idx)) as cut from c where cum - len(w) < most group by doc_id, most")
def q_short_sets(spark, sf_dir):
    s = S.sentence_table(_docs(spark, sf_dir))
    out = None
    for most in (50, 100, 900):
        t = C.truncate_words(s, F.lit(most)).select("doc_id", F.lit(most).alias("most"), "n_words", F.md5("text").alias("cut"))
        out = t if out is None else out.unionByName(t)
    return out


@query("q_long_triples", "with r as (select doc_id, label, domain, text, row_number() over (partition by label, domain order by md5('7' || doc_id), doc_id) - 1 as rn from documents where text is not null and label is not null and domain is not null), j as (select label, domain, rn // 3 as part, count(*) as n, list(doc_id order by rn) as doc_ids, string_agg(text, chr(10) || chr(10) order by rn) as text from r group by 1, 2, 3) select label, domain, part, doc_ids, md5(text) as joined from j where n = 3")
def q_long_triples(spark, sf_dir):
    d = _docs(spark, sf_dir).where("label is not null and domain is not null").select("doc_id", "label", "domain", "text")
    return C.concatenated(d, ["label", "domain"]).select("label", "domain", "part", "doc_ids", F.md5("text").alias("joined"))


@query("q_reorder_sentences", f"with {P.SENTS}, r as (select *, row_number() over (partition by doc_id, para order by idx) as rn, count(*) over (partition by doc_id, para) as n from s), o as (select *, case when n <= 2 or rn = 1 then '' else md5('7|' || doc_id || '|' || idx) end as h from r), p as (select doc_id, para, string_agg(s, ' ' order by h, idx) as p from o group by doc_id, para) select doc_id, md5(string_agg(p, chr(10) || chr(10) order by para)) as mixed from p group by doc_id")
def q_reorder_sentences(spark, sf_dir):
    return C.reorder_sentences(S.sentence_table(_docs(spark, sf_dir))).select("doc_id", F.md5("text").alias("mixed"))


def _casual_sql() -> str:
    x = "text"
    for long, short in L.CONTRACTIONS:
        x = f"regexp_replace({x}, '(?i)\\b{long}\\b', {P.q(short)}, 'g')"
    return f"replace(regexp_replace({x}, '; +([\\p{{L}}])', '. \\1', 'g'), ' — ', ', ')"


@query("q_casualize", f"with {P.DOCS} select doc_id, md5({_casual_sql()}) as casual from d")
def q_casualize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(C.casualize(F.col("text"))).alias("casual"))


@query("q_typo_noise")
def q_typo_noise(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.length("text").alias("n_before"), C.typo_noise(F.col("text"), F.col("doc_id")).alias("noisy"))


@query("q_merge_split")
def q_merge_split(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_before"), F.size(T.sentences(C.merge_split(F.col("text")))).alias("n_after"))


@query("q_hybrids")
def q_hybrids(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return C.hybrids(d, S.sentence_table(d))
