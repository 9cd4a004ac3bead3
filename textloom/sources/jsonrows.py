"""JSON rows: scans, sinks and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sample schema.
SAMPLE = "id string, text string, label int, ai_fraction double, hybrid_class int, author_type string, generator string, generator_family string, model_version string, prompt_type string, domain string, genre string, language string, n_words int, generation_date string, editing_level string, paraphrasing_level string, writer_group string, source_dataset string, group_id string, segments array<array<int>>, eval_set string, split string, augmented string, perturbation string, perturbation_level int"


def parsed(json: Column, schema: str) -> Column:
    """A struct of the fields; null for broken JSON."""
    return F.from_json(json, schema, {"mode": "PERMISSIVE"})


def clean_number(x: Column, digits: int = 5) -> Column:
    """Null for NaN and infinities, else rounded."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.round(x, digits))


def read_jsonl(spark: SparkSession, path: str, schema: str = SAMPLE, strict: bool = True) -> DataFrame:
    """One JSON object a line; blank lines are skipped; strict: a broken line is an error, else it is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
