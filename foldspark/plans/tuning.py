"""Grains from the engine's own measurements: ``python -m foldspark.plans.tuning --table PATH --column X --by G``.

Each kind of reduction runs once over a table of the user's.  The engine reports how long its tasks ran in all; elements
a task-second times the seconds that a task should last are the grain.  So the tuner needs no candidates and no clock of
its own, and a cluster's own tasks are what is measured.
"""

from __future__ import annotations

import argparse
import platform
import uuid
from collections.abc import Sequence

import pyspark
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..operators.frame import reduce
from . import config

#: A reduction of each kind.
SAMPLES: dict[str, tuple[str, dict]] = {
    "axis_scan_plain": ("mean", {}),
    "axis_scan_nan": ("count_finite", {}),
    "axis_scan_var": ("var", {}),
    "axis_weighted": ("average", {"weights": True}),
    "axis_order_median": ("median", {}),
    "axis_order_percentile": ("percentile", {"q": [16, 50, 84]}),
    "minmax_1d": ("minmax", {}),
}


def task_seconds(found: DataFrame) -> float:
    """Runs a plan and gives the seconds that its tasks ran in all, from the stages' metrics."""
    context = found.sparkSession.sparkContext
    group = f"foldspark-{uuid.uuid4().hex}"
    context.setJobGroup(group, "measured for a grain")
    try:
        found.write.format("noop").mode("overwrite").save()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = map(context.statusTracker().getJobInfo, context.statusTracker().getJobIdsForGroup(group))
    stages = {stage for job in jobs if job for stage in job.stageIds}
    store, total = context._jsc.sc().statusStore(), 0
    for stage in stages:
        try:
            total += store.lastStageAttempt(stage).executorRunTime()
        except Py4JJavaError:  # a stage that was skipped has none
            continue
    return total / 1000


def grain_from(elements: int, ran: float, seconds: float) -> int:
    """The power of two nearest below the elements that one task takes in so many seconds."""
    return 1 << max(0, int(elements * seconds / max(ran, 1e-3)).bit_length() - 1)


def tuned(table: DataFrame, column: str, by: Sequence[str], weights: str, seconds: float) -> dict[str, int]:
    """A grain for each kind of reduction."""
    elements = table.count()
    out = {}
    for grain, (op, options) in SAMPLES.items():
        own = {**options, "weights": weights} if "weights" in options else options
        out[grain] = grain_from(elements, task_seconds(reduce(table, op, column, by=list(by), **own)), seconds)
    return out


def print_environment(spark: SparkSession) -> None:
    print(f"Python {platform.python_version()}, PySpark {pyspark.__version__}, {platform.machine()}, master {spark.sparkContext.master}, {config.get_num_threads(spark)} tasks at once")


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Measures reductions of a table and saves grains.")
    parser.add_argument("--table", help="a Parquet table")
    parser.add_argument("--column", help="a numeric column")
    parser.add_argument("--weights", help="a column of weights; the column itself if not said")
    parser.add_argument("--by", default="", help="keys, by commas")
    parser.add_argument("--seconds", type=float, default=1.0, help="how long a task should last")
    parser.add_argument("--config", help="file of the grains")
    parser.add_argument("--no-save", action="store_true")
    parser.add_argument("--reset", action="store_true", help="remove saved grains")
    said = parser.parse_args(arguments)
    if said.reset:
        print("removed" if config.clear_parallel_grains_config(said.config) else "there was no file")
        return 0
    if not (said.table and said.column):
        parser.error("say --table and --column, or --reset")
    spark = SparkSession.builder.getOrCreate()
    print_environment(spark)
    table = spark.read.parquet(said.table)
    found = tuned(table, said.column, [k for k in said.by.split(",") if k], said.weights or said.column, said.seconds)
    config.set_parallel_grains(found)
    for name, value in found.items():
        print(f"{name}: {value}")
    if not said.no_save:
        print(f"saved to {config.save_parallel_grains_config(found, said.config)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
