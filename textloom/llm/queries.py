"""The p-queries, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import crosssplit, cutoff, garbled, languages, leaks, mixture, nearcopies, pairdefects, splitplan
from textloom.session import table

#: Shared SQL: the five-token windows of the samples, delivered copies once.
_WINDOWS = r"""
s as (select id, any_value(text) as text, any_value(split) as split, any_value(eval_set) as eval_set from samples where id is not null and text is not null group by id),
tok as (select id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from s),
sh as (select distinct id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] as g from (select id, w, unnest(range(1, len(w) - 3)) as i from tok)),
n as (select id, count(*) as n from sh group by id),
met as (select a.id as id_a, b.id as id_b, count(*) as k from sh a join sh b on a.g = b.g and a.id < b.id group by 1, 2),
pairs as (select id_a, id_b from met join n x on x.id = id_a join n y on y.id = id_b where k >= 0.5 * (x.n + y.n - k))"""

#: Both directions of all pairs of records, those of equal texts too (texts too short for windows among them).
_EDGES = "ed0 as (select id_a, id_b from pairs union select a.id, b.id from s a join s b on a.text = b.text and a.id < b.id), ed as (select id_a as x, id_b as y from ed0 union all select id_b, id_a from ed0)"
_ROLE = "side as (select id, case when eval_set is not null or split in ('calib', 'test') then 2 when split = 'train' then 1 end as role, coalesce(eval_set, split) as place, source_dataset from sd)"

_SQL = {
    "p2_groups": f"""with recursive {_WINDOWS}, {_EDGES}, re as (select id as x, id as y from s union select re.x, ed.y from re join ed on ed.x = re.y), g as (select x as id, min(y) as group_id from re group by 1)
select s.id, group_id, (select count(*) from s b where b.text = s.text) as n_copies, (select count(distinct b.text) from ed join s b on b.id = ed.y where ed.x = s.id and b.text <> s.text) as n_links from s join g using (id)""",
    "p6_report": rf"""with {_WINDOWS}, {_EDGES}, sd as (select id, any_value(split) as split, any_value(eval_set) as eval_set, any_value(source_dataset) as source_dataset from samples where id is not null and text is not null group by id), {_ROLE},
cn as (select s.id, case when len(w) >= 5 then array_to_string(w, ' ') else chr(10) || text end as c from s join tok using (id)),
mt as (select ed.x as id, ed.y as other from ed join side a on a.id = ed.x join side b on b.id = ed.y where a.role = 2 and b.role = 1),
per as (select mt.id, count(*) as k, bool_or(a.c = b.c) as e from mt join cn a on a.id = mt.id join cn b on b.id = mt.other group by 1)
select place, source_dataset, count(*) as n_records, count(*) filter (where e) as n_exact, count(*) filter (where not e) as n_near_only, coalesce(sum(k), 0)::bigint as n_pairs from side left join per using (id) where role = 2 group by 1, 2""",
    "p7_items": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(any_value(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where doc_id is not null and text is not null group by doc_id),
e as (select item_id, list_filter(regexp_split_to_array(lower(any_value(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from eval_items where item_id is not null and text is not null group by item_id),
dg as (select doc_id, i as pa, array_to_string(w[i:i+11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
eg as (select item_id, i as pb, array_to_string(w[i:i+11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from e)),
h as (select doc_id, item_id, pa, pa - pb as diag from dg join eg using (g)), il as (select *, pa - row_number() over (partition by doc_id, item_id, diag order by pa) as island from h),
rn as (select doc_id, item_id, count(*) + 11 as length from il group by doc_id, item_id, diag, island), t as (select item_id, count(distinct doc_id) as n_documents, max(length) as longest_run from rn group by 1)
select item_id, eval_set, coalesce(n_documents, 0) as n_documents, coalesce(longest_run, 0) as longest_run from (select distinct item_id, any_value(eval_set) over (partition by item_id) as eval_set from eval_items where item_id is not null) left join t using (item_id)""",
    "p2_found": f"with {_WINDOWS} select id_a, id_b from pairs",
    "p7_found": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where doc_id is not null and text is not null),
e as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from eval_items where item_id is not null and text is not null),
dg as (select distinct doc_id, array_to_string(w[i:i+11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
eg as (select distinct item_id, array_to_string(w[i:i+11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from e))
select distinct doc_id, item_id from dg join eg using (g)""",
    "p6_found": f"""with {_WINDOWS}, side as (select id, case when eval_set is not null or split in ('calib', 'test') then 2 when split = 'train' then 1 end as role from s)
select id_a, id_b from pairs join side x on x.id = id_a join side y on y.id = id_b where x.role + y.role = 3""",
}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_duplicate_pairs(table(spark, sf_dir, "samples"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_duplicate_groups(table(spark, sf_dir, "samples"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.cross_split_pairs(table(spark, sf_dir, "samples"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.cross_split_report(table(spark, sf_dir, "samples"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.cut_records(table(spark, sf_dir, "samples")).selectExpr("key as id")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.cut_rates(table(spark, sf_dir, "samples"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairdefects.pair_defects(table(spark, sf_dir, "generations"), table(spark, sf_dir, "samples"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairdefects.defect_rates(table(spark, sf_dir, "generations"), table(spark, sf_dir, "samples"))


def p4_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitplan.assign_splits(table(spark, sf_dir, "samples"), table(spark, sf_dir, "split_targets"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitplan.split_report(table(spark, sf_dir, "samples"), table(spark, sf_dir, "split_targets"))


def _mix_spec(spark: SparkSession) -> mixture.MixSpec:
    """The vocabulary's path by the session's setting, where there is one."""
    return mixture.MixSpec(tokenizer=spark.conf.get("spark.textloom.tokenizer", mixture.MixSpec.tokenizer))


def p8_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), _mix_spec(spark))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), _mix_spec(spark))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.mislabelled_segments(table(spark, sf_dir, "samples"))


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.document_languages(table(spark, sf_dir, "samples"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.changed_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_documents(table(spark, sf_dir, "documents"))


_QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_groups, p3_found, p3_rates, p4_assignment, p4_report, p5_found, p5_languages, p6_found, p6_report, p7_found, p7_items, p7_changed, p8_uses, p8_report, p9_found, p9_restored)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
