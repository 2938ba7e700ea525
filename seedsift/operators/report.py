"""Reports on what happened to keywords. events: (seed_id, kw_id, stage, stage_no, label, reason), one row per stage that saw a keyword."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_report(events: DataFrame) -> DataFrame:
    """Per stage: rows in, blocked, grey, valid, and what goes on."""
    by = events.groupBy("stage_no", "stage").agg(
        F.count("*").alias("n_in"), F.count_if(F.col("label") == "TRASH").alias("n_blocked"), F.count_if(F.col("label") == "GREY").alias("n_grey"), F.count_if(F.col("label") == "VALID").alias("n_valid")
    )
    return by.withColumn("n_out", F.col("n_in") - F.col("n_blocked"))


def first_blocker(events: DataFrame) -> DataFrame:
    """The first stage and reason that blocked a keyword."""
    return events.where("label = 'TRASH'").groupBy("seed_id", "kw_id").agg(F.min(F.struct("stage_no", "stage", "reason")).alias("b")).select("seed_id", "kw_id", "b.stage", "b.reason")


def keyword_trace(events: DataFrame) -> DataFrame:
    """A keyword's path as 'stage:label' up to its first block, and where it ended. A keyword meets each stage once, so paths are short."""
    steps = F.array_sort(F.collect_list(F.struct("stage_no", "stage", "label")))
    by = events.groupBy("seed_id", "kw_id").agg(steps.alias("s"))
    at = F.array_position(F.transform("s", lambda x: x["label"]), "TRASH").cast("int")
    path = F.when(at > 0, F.slice("s", F.lit(1), at)).otherwise(F.col("s"))
    last = F.element_at(path, -1)["label"]
    status = F.when(last == "TRASH", "blocked").when(last == "GREY", "grey").otherwise("passed")
    return by.select("seed_id", "kw_id", F.array_join(F.transform(path, lambda x: F.concat_ws(":", x["stage"], x["label"])), ">").alias("path"), status.alias("status"))


def trace_details(events: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """One column per stage with the label that it gave."""
    return events.groupBy("seed_id", "kw_id").pivot("stage", list(stages)).agg(F.first("label"))


def query_trace(events: DataFrame, label: str | None = None, reason: str | None = None) -> DataFrame:
    """Rows by label and by part of the reason; reason 'none' asks for rows without one."""
    out = events if label is None else events.where(F.col("label") == label)
    return out if reason is None else out.where(F.col("reason").isNull() if reason == "none" else F.col("reason").contains(reason))


def report_text(report: DataFrame) -> DataFrame:
    """A line of text for each stage."""
    line = F.concat_ws(" ", F.lpad(F.col("stage_no").cast("string"), 2, "0"), "stage", *(F.concat(F.lit(f"{n}="), F.col(f"n_{n}").cast("string")) for n in ("in", "blocked", "grey", "valid", "out")))
    return report.select("stage_no", line.alias("line"))
