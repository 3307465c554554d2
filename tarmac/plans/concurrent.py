"""Independent Spark jobs side by side, with a bound."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], Result]], bound: int = 4) -> list[Result]:
    """Results of all tasks in their order, at most ``bound`` of them running at a time.

    Every running task has a scheduler pool of its own, so that under ``spark.scheduler.mode`` FAIR, which ``with_settings`` asks for, a long
    fit does not hold back short ones. The first error ends the rest that have not begun and is raised.
    """
    if bound < 1:
        raise ValueError("at least one task has to run at a time")
    free, lock = list(range(bound)), Lock()
    failed: list[BaseException] = []

    def run(task: Callable[[], Result]) -> Result | None:
        if failed:
            return None
        with lock:
            place = free.pop()
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-by-side-{place}")
            return task()
        except BaseException as error:
            failed.append(error)
            raise
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            with lock:
                free.append(place)

    with ThreadPoolExecutor(bound) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(run), task) for task in tasks]
        for future in futures:
            future.exception()
    if failed:
        raise failed[0]
    return [future.result() for future in futures]
