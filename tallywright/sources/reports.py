"""Published claims, file catalogue, columnar sink and report rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.functions import parsing
from tallywright.sources.files import model_of, read_documents

TABLE_LINE = r"^\s*(?:> ?)*\|"
RULE_LINE = r"^\s*(?:> ?)*\|[\s:|-]+$"
LINK = r"\[([^\]]*)\]\([^)]*\)"

# What a file is, from its name. The first match counts.
FILE_KINDS = {
    r"bench_c[0-9]+.*\.json$": "bench_level",
    r"throughput_sweep\.csv$": "sweep_csv",
    r"sweep[^/]*\.log$": "sweep_log",
    r"exit_statuses[^/]*\.yaml$": "exit_status",
    r"swebench[^/]*\.json$|_report\.json$": "grader_report",
    r"swe_scoring[^/]*\.log$": "progress_log",
    r"DIAGNOSIS\.json$": "diagnosis",
    r"replay[^/]*\.json$": "replay",
    r"(RESULTS|SUMMARY)\.txt$|\.log$": "agent_log",
    r"results[^/]*\.json$": "eval_results",
    r"\.md$": "report",
}


def _cells(line: Column) -> Column:
    """Cells of a pipe-table line, trimmed; the outer pipes are dropped."""
    inner = F.regexp_replace(F.regexp_replace(line, TABLE_LINE, ""), r"\|\s*$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Pipe tables of Markdown reports -> one row per cell.

    The first line of a block of table lines names the metrics; the first cell
    of a row names what is described.
    """
    lines = read_documents(spark, path).select(
        "file", F.posexplode(F.split("text", "\r?\n")).alias("_at", "text")
    ).withColumn("is_table", F.col("text").rlike(TABLE_LINE))
    # A report is a small document, so a window per file stays small too.
    w = Window.partitionBy("file").orderBy("_at")
    first = F.col("is_table") & ~F.coalesce(F.lag("is_table").over(w), F.lit(False))
    headed = lines.withColumn("_head", F.when(first, F.col("text"))).withColumn(
        "header",
        F.last("_head", ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    body = headed.where(
        F.col("is_table") & F.col("_head").isNull() & ~F.col("text").rlike(RULE_LINE)
    ).withColumn("line", F.col("_at") + 1)
    cells, names = _cells(F.col("text")), _cells(F.col("header"))
    rows = body.select(
        "file", "line", F.get(cells, F.lit(0)).alias("_subject"),
        F.posexplode(F.arrays_zip(names.alias("metric"), cells.alias("raw"))).alias("_pos", "_cell"),
    ).where(F.col("_pos") > 0)
    measure = parsing.parse_measure(F.col("raw"))
    return rows.select(
        F.col("file").alias("source"),
        F.col("line").cast("int").alias("line"),
        F.trim(
            F.regexp_replace(F.regexp_replace("_subject", LINK, "$1"), r"\*\*", "")
        ).alias("model"),
        F.col("_cell.metric").alias("metric"),
        F.col("_cell.raw").alias("raw"),
    ).select(
        "source", "line", "model", "metric", "raw",
        measure["value"].alias("value"), measure["unit"].alias("unit"),
        measure["denominator"].alias("denominator"),
        measure["qualifier"].alias("qualifier"), measure["state"].alias("state"),
    )


def catalog_runs(spark: SparkSession, root: str) -> DataFrame:
    """Inventory of artefacts below a folder. File contents are not read."""
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(FILE_KINDS.items()):
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(
            "path",
            model_of(F.col("path")).alias("model"),
            F.coalesce(kind, F.lit("other")).alias("kind"),
            "length",
            F.col("modificationTime").alias("modified"),
        )
    )


def write_gold(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("model", "task"),
    mode: str = "errorifexists",
) -> None:
    """Partitioned Parquet sink.

    Rows are rebalanced on the partition columns: small ones share a task and
    the rows of a dominant one are split over several, so neither tiny files
    nor a single overlong writer appear.
    """
    df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def render_report(board: DataFrame, subject: str, columns: Sequence[str]) -> DataFrame:
    """Leaderboard -> Markdown lines (pos, line); a missing score shows as a dash.

    The header rows carry positions 0 and 1; sort by ``(pos, line)`` to print.
    """
    spark = board.sparkSession
    cells = [
        F.coalesce(F.round(F.col(c) * 100, 2).cast("decimal(10,2)").cast("string"), F.lit("—"))
        for c in columns
    ]
    suffixed = [F.when(c == "—", c).otherwise(F.concat(c, F.lit("%"))) for c in cells]
    body = board.select(
        F.lit(2).alias("pos"),
        F.concat(
            F.lit("| "), F.concat_ws(" | ", F.col(subject), *suffixed), F.lit(" |")
        ).alias("line"),
    )
    head = "| " + " | ".join([subject, *columns]) + " |"
    rule = "| " + " | ".join(["---"] * (len(columns) + 1)) + " |"
    top = spark.range(2).select(
        F.col("id").cast("int").alias("pos"),
        F.when(F.col("id") == 0, head).otherwise(rule).alias("line"),
    )
    return top.unionByName(body)


def write_report(board: DataFrame, subject: str, columns: Sequence[str], path: str) -> None:
    """Write a rendered leaderboard as one text file; its size is that of a report."""
    ordered = render_report(board, subject, columns).orderBy("pos", "line")
    ordered.select("line").coalesce(1).write.text(path)
