"""Task control: cancelling a running action, and counting its rows as it runs."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Task:
    """An action on a thread of its own, under a tag by which it can be cancelled."""

    def __init__(self, spark: SparkSession, tag: str, action: Callable[[], Any]):
        self._spark, self.tag = spark, tag

        def run() -> Any:
            spark.sparkContext.addJobTag(tag)
            try:
                return action()
            finally:
                spark.sparkContext.removeJobTag(tag)

        self._pool = ThreadPoolExecutor(1)
        self._future = self._pool.submit(run)

    def cancel(self) -> None:
        """Cancel the running jobs of the action; its result is then an error that says so."""
        self._spark.sparkContext.cancelJobsWithTag(self.tag)

    def result(self, timeout: float | None = None) -> Any:
        try:
            return self._future.result(timeout)
        finally:
            self._pool.shutdown(wait=False)


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """A frame that counts its rows while an action runs over it; read the observation's ``get`` afterwards."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
