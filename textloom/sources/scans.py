"""Scans of raw corpora in their folder layouts, as sample rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators.corpus import capped


def read_pairs(spark: SparkSession, folder: str, machine_cap: int, human_cap: int) -> DataFrame:
    """(domain, generator, label, text, prompt): one file ``<domain>_<generator>.jsonl`` a generator.

    Fields are named differently by domain: human_text, human_reviews (array)
    or text; machine_text, machine_reviews (array) or machine_abstract.  Broken
    lines are left out, human texts count once a domain, and caps choose by
    seeded hash.
    """
    schema = "prompt string, human_text string, machine_text string, human_reviews array<string>, machine_reviews array<string>, text string, machine_abstract string"
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*_*.jsonl").json(folder).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1))
    raw = raw.select(F.substring_index("file", "_", 1).alias("domain"), F.expr("substring(file, length(substring_index(file, '_', 1)) + 2)").alias("generator"), "prompt", F.coalesce(F.slice("human_reviews", 1, 2), F.array(F.coalesce("human_text", "text"))).alias("h"), F.coalesce(F.slice("machine_reviews", 1, 2), F.array(F.coalesce("machine_text", "machine_abstract"))).alias("m"))
    pairs = raw.select("domain", "generator", "prompt", F.explode(F.arrays_zip("h", "m")).alias("p")).select("domain", "generator", "prompt", F.col("p.h").alias("h"), F.col("p.m").alias("m"))
    human = capped(pairs.where("trim(h) <> ''").select("domain", F.lit("none").alias("generator"), F.lit(0).alias("label"), F.col("h").alias("text"), F.lit(None).cast("string").alias("prompt")).dropDuplicates(["domain", "text"]), ["domain"], "text", human_cap)
    machine = capped(pairs.where("trim(m) <> ''").select("domain", "generator", F.lit(1).alias("label"), F.col("m").alias("text"), "prompt"), ["domain", "generator"], "text", machine_cap)
    return human.unionByName(machine)


def read_text_tree(spark: SparkSession, root: str, pattern: str = r"/([^/]+)/([^/]+)/([^/]+)\.txt$", cap: int | None = None) -> DataFrame:
    """(domain, source, key, text): whole files, their place told by their path."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True).withColumn("path", F.input_file_name())
    rows = raw.select(*[F.regexp_extract("path", pattern, i + 1).alias(c) for i, c in enumerate(("domain", "source", "key"))], F.col("value").alias("text")).where("key <> ''")
    return rows if cap is None else capped(rows, ["domain", "source"], "key", cap)


def recover_labels(perturbed: DataFrame, originals: DataFrame, prefix: int = 300) -> DataFrame:
    """Perturbed documents with the label and group of their unperturbed original.

    perturbed: key, level, text; originals: label, group_key, text.  A key's
    level-0 text is looked up by the sha1 of its first characters; keys that
    match no original are left out.
    """
    h = lambda c: F.sha1(F.left(F.trim(c), F.lit(prefix)))
    index = originals.select(h(F.col("text")).alias("h"), "label", "group_key").dropDuplicates(["h"])
    labels = perturbed.where("level = 0").select("key", h(F.col("text")).alias("h")).join(index, "h").select("key", "label", "group_key").dropDuplicates(["key"])
    return perturbed.join(labels, "key")


def read_nested_sets(spark: SparkSession, folder: str, names: dict[str, str]) -> DataFrame:
    """(eval_set, text): JSON arrays ``<set>/.../data.json`` of the sets named, under their new names."""
    raw = spark.read.schema("document string").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "data.json").json(folder).withColumn("path", F.input_file_name())
    known = F.broadcast(spark.createDataFrame(sorted(names.items()), "folder string, eval_set string"))
    return raw.withColumn("folder", F.regexp_extract("path", r"/([^/]+)/data\.json$", 1)).join(known, "folder").where("trim(document) <> ''").select("eval_set", F.col("document").alias("text"))


def pack_paragraphs(texts: DataFrame, key: str, least: int = 300, least_paragraph: int = 8) -> DataFrame:
    """(key, chunk, text): paragraphs of eight words or more packed in order into chunks of ``least`` words; a rest is left out."""
    parts = F.filter(T.paragraphs(F.col("text")), lambda p: T.count_words(p) >= least_paragraph)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(a, p):
        joined = F.when(a["open"] == "", p).otherwise(F.concat(a["open"], F.lit("\n\n"), p))
        n = a["n"] + T.count_words(p)
        full = n >= least
        return F.struct(F.when(full, F.concat(a["done"], F.array(joined))).otherwise(a["done"]).alias("done"), F.when(full, "").otherwise(joined).alias("open"), F.when(full, 0).otherwise(n).alias("n"))

    return texts.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.aggregate(parts, start, step, lambda a: a["done"])).alias("chunk", "text"))


def decode(raw: bytes, encodings: tuple[str, ...] = ("utf-8-sig", "utf-16", "cp1253", "iso8859_7", "latin-1")) -> str:
    """Text of bytes by the first encoding that reads them; UTF-16 only behind its mark."""
    for name in encodings:
        if name == "utf-16" and raw[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, error) of .txt and .md files of any encoding; other kinds have an error and no text."""

    def run(batches):
        for b in batches:
            paths, texts, errors = b.column("path").to_pylist(), [], []
            for path, raw in zip(paths, b.column("content").to_pylist()):
                good = path.lower().endswith((".txt", ".md"))
                texts.append(decode(raw) if good else None)
                errors.append(None if good else "unsupported kind of file")
            yield pa.RecordBatch.from_pydict({"path": b.column("path"), "text": pa.array(texts, pa.string()), "error": pa.array(errors, pa.string())})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content").mapInArrow(run, "path string, text string, error string")


def read_local(spark: SparkSession, path: str, language: str, least: int = 40) -> DataFrame:
    """Local JSON lines with text and label; short texts are left out; rows with eval_set are for evaluation only."""
    from textloom.sources.jsonrows import read_jsonl

    rows = read_jsonl(spark, path).where("text is not null and label is not null").withColumn("language", F.coalesce("language", F.lit(language)))
    return rows.where(T.count_words(F.col("text")) >= least).withColumn("evaluation_only", F.col("eval_set").isNotNull())


def write_settings(there: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value settings after an upsert: of equal keys the new one."""
    both = there.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_o")))).where("_r = 1").drop("_o", "_r")


def write_run_log(spark: SparkSession, record: dict, folder: str) -> None:
    """One JSON file a run; NaN and infinities are null."""
    import json
    import math

    def clean(x):
        if isinstance(x, float) and (math.isnan(x) or math.isinf(x)):
            return None
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, list | tuple) else x

    spark.createDataFrame([(json.dumps(clean(record)),)], "value string").coalesce(1).write.mode("append").text(folder)


def read_run_logs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(folder)
