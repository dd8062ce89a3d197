"""The log of runs and its mirror in the cost table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of the mirror that the log has not.
MIRROR_ONLY = ["trace_id", "artifact_verified"]


def log_and_mirror(runs: DataFrame, project: str = "gazetta", task_type: str = "brief") -> tuple[DataFrame, DataFrame]:
    """(log, mirror) of runs (run_id, task, agent, cost, status, trace_id, artifact_verified).

    The mirror has defaults where the log has nulls: no cost is 0, no task is
    ``task_type``, a run without a trace is on its own.
    """
    solo = F.concat(F.lit("solo-"), F.coalesce("agent", F.lit("?")))
    mirror = runs.select(
        "run_id",
        F.coalesce("trace_id", solo).alias("trace_id"),
        F.lit(project).alias("project"),
        F.coalesce("task", F.lit(task_type)).alias("task_type"),
        "agent",
        F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("actual_cost"),
        "status",
        F.coalesce("artifact_verified", F.lit(False)).alias("artifact_verified"),
    )
    return runs.drop(*MIRROR_ONLY), mirror
