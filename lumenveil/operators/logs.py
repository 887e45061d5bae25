"""Log lines of tasks: cleaning, retention and tails.

Newest-n per task ranks in two levels: every slice of a task ranks its own rows
first, so a task with a third of all lines is not ranked in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEPT = 5000
LONGEST = 2000
SLICES = 64


def cleaned(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines without trailing blanks, at most 2000 characters; empty ones go."""
    return lines.withColumn(column, F.substring(F.rtrim(F.col(column)), 1, LONGEST)).filter(F.col(column) != "")


def newest(logs: DataFrame, n: int = KEPT) -> DataFrame:
    """The ``n`` newest lines of every task, by id."""
    sliced = logs.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)))
    first = Window.partitionBy("task_id", "_slice").orderBy(F.desc("id"))
    some = sliced.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= n)
    last = Window.partitionBy("task_id").orderBy(F.desc("id"))
    return some.withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") <= n).drop("_rank", "_slice")


def tail(logs: DataFrame, task_id: str, n: int) -> DataFrame:
    """The last ``n`` lines of a task, oldest first."""
    return logs.filter(F.col("task_id") == task_id).orderBy(F.desc("id")).limit(n).orderBy("id")


def rolling_tail(logs: DataFrame, n: int = 20) -> DataFrame:
    """Every line with the ``n`` lines up to it, joined by line feeds."""
    window = Window.partitionBy("task_id").orderBy("id").rowsBetween(1 - n, 0)
    return logs.withColumn("tail", F.array_join(F.collect_list("line").over(window), "\n"))


def without_completed(logs: DataFrame, tasks: DataFrame) -> DataFrame:
    return logs.join(tasks.filter("status = 'completed'").select("task_id"), "task_id", "left_anti")
