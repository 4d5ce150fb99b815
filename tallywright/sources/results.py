"""Readers of evaluation results, replays and diagnoses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright import schemas
from tallywright.functions import answers, parsing
from tallywright.sources.files import read_documents, run_of


def parse_eval_results(documents: DataFrame) -> DataFrame:
    """Result documents (file, text) -> the long ``metrics`` table.

    One narrow pass: a file's nested maps become rows by two explodes.
    """
    d = documents.select("file", F.from_json("text", schemas.EVAL_RESULT).alias("d"))
    tasks = d.select("file", "d", F.explode("d.results").alias("task", "entries"))
    rows = tasks.select(
        "file", "d", "task", "entries", F.explode("entries").alias("key", "raw")
    ).where(F.col("key").contains(","))
    key = parsing.split_metric_key(F.col("key"))
    clock = parsing.parse_run_clock(F.col("d.date"), F.col("d.total_evaluation_time_seconds"))
    task = F.col("task")
    # What the client asked for wins over the benchmark's own settings.
    asked = parsing.parse_model_args(F.col("d.config.gen_kwargs"))
    settings = F.try_element_at("d.configs", task)
    own = F.coalesce(settings["generation_kwargs"], F.create_map().cast("map<string,string>"))
    examples = F.create_map(F.lit("num_fewshot"), settings["num_fewshot"])
    asked = F.coalesce(asked, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(asked, k) & (k != "num_fewshot"))
    generation = F.map_concat(F.map_filter(kept, lambda k, v: v.isNotNull()), F.map_filter(asked, lambda k, v: k != "num_fewshot"), examples)
    return rows.select(
        F.col("d.model_name").alias("model"),
        "task",
        key["metric"].alias("metric"),
        key["filter"].alias("filter"),
        key["is_stderr"].alias("is_stderr"),
        F.col("raw").try_cast("double").alias("value"),
        F.coalesce(
            F.try_element_at(F.col("d.n-samples"), task)["effective"],
            F.try_element_at("entries", F.lit("sample_len")).try_cast("bigint"),
        ).alias("n"),
        F.col("d.lm_eval_version").alias("harness_version"),
        parsing.parse_model_args(F.col("d.config.model_args")).alias("model_args"),
        F.try_element_at("d.task_hashes", task).alias("task_hash"),
        F.try_element_at(generation, F.lit("max_gen_toks")).try_cast("bigint").alias("max_gen_toks"),
        F.map_filter(generation, lambda k, v: v.isNotNull() & (k != "max_gen_toks")).alias("generation"),
        clock["eval_seconds"].alias("eval_seconds"),
        clock["run_ts"].alias("run_ts"),
        "file",
    )


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation result JSON of any harness generation -> ``metrics``."""
    return parse_eval_results(read_documents(spark, path))


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of replayed samples -> rows."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .schema(schemas.REPLAY)
        .json(path, multiLine=True)
        .select(
            run_of(F.col("_metadata.file_path")).alias("run"),
            F.col("doc").alias("doc_id"),
            F.col("fr").alias("finish_reason"),
            F.col("ct").alias("completion_tokens"),
            "pred",
            "gold",
            "correct",
        )
    )


def _diagnoses(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path).select(
        F.from_json("text", schemas.DIAGNOSIS).alias("d")
    ).select("d.*")


def read_diagnosis(spark: SparkSession, path: str) -> DataFrame:
    """Items per terminal status of diagnosed runs."""
    return _diagnoses(spark, path).select("run", F.explode("counts").alias("status", "n"))


def read_diagnosis_examples(spark: SparkSession, path: str) -> DataFrame:
    """Example failures of diagnosed runs, with the parser error's offset."""
    rows = _diagnoses(spark, path).select("run", F.explode("examples").alias("e"))
    return rows.select(
        "run",
        F.col("e.instance").alias("instance_id"),
        F.col("e.successful_command_execs").alias("successful_execs"),
        answers.error_class(F.col("e.sample_error")).alias("error"),
        answers.error_offset(F.col("e.sample_error")).alias("error_offset"),
    )
