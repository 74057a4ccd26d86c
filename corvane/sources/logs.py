"""Logs, task files and registries as tables, and the shaping of fetched answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK_SCHEMA = "id string, title string, status string, owner string, blocks array<string>, metadata struct<_internal: boolean>"
PROJECT_SCHEMA = "path string, n_files bigint, n_chunks bigint, model_id string, incomplete boolean"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of an append-only log; lines that aren't JSON of the schema are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines."""
    df.write.mode("append").json(path)


def read_tasks(spark: SparkSession, glob: str) -> DataFrame:
    """Task files, one JSON object each, the latest first; internal ones are hidden."""
    tasks = spark.read.schema(TASK_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(glob)
    seen = tasks.select("*", F.col("_metadata.file_modification_time").alias("modified_at"))
    return seen.where(~F.coalesce("metadata._internal", F.lit(False)) & F.col("id").isNotNull()).drop("metadata").orderBy(F.desc("modified_at"), "id")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of projects as rows: project and its fields; anything but an object gives no rows."""
    text = spark.read.option("wholetext", True).text(path)
    parsed = F.from_json("value", f"map<string, struct<{PROJECT_SCHEMA.replace(' ', ': ').replace(',:', ',')}>>")
    return text.select(F.explode(parsed).alias("project", "p")).select("project", "p.*")


def with_accepted_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with their accepted answer, if there is one: a left join by its id."""
    return questions.join(answers.select(F.col("answer_id").alias("accepted_answer_id"), F.col("body").alias("answer")), "accepted_answer_id", "left")


def order_extracts(pages: DataFrame) -> DataFrame:
    """Encyclopedia pages with an extract, in the engine's order; pages without a place come last."""
    return pages.where(F.col("extract").isNotNull() & (F.col("extract") != "")).orderBy(F.coalesce("index", F.lit(1_000_000)), "title")


def parse_code_hits(text, schema_file: str = "file"):
    """(repository, path, snippet) of the blocks of a code search answer."""
    blocks = F.split(text, r"\n(?=Repository: )")
    part = lambda b, p: F.regexp_extract(b, p, 1)
    hits = F.transform(
        blocks,
        lambda b: F.struct(
            part(b, r"Repository: (\S+)").alias("repository"), part(b, r"Path: (\S+)").alias("path"), part(b, r"(?s)Snippets?:\s*(.*)$").alias("snippet")
        ),
    )
    return F.filter(hits, lambda h: h["repository"] != "")


def merge_registry(old: DataFrame, measured: DataFrame) -> DataFrame:
    """The registry after an update: only fields that were measured replace old ones."""
    from corvane.operators.index import carry_over

    return carry_over(measured, old, ["project"])
