"""Folders of stream outputs that readers see only once a batch is complete.

Each output of a batch is a folder ``<name>/run=<run>/batch_id=<id>``; the manifest has one
small file per committed batch, written last.  What is not in the manifest, such as what a
broken attempt left behind, is not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run STRING, batch_id BIGINT, names ARRAY<STRING>, committed_at TIMESTAMP"


class CommittedFolders:
    """The outputs below ``root``.  A run is one stream with its checkpoint; batches count from 0 in each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, run: str, batch_id: int) -> str:
        return f"{self.root}/{name}/run={run}/batch_id={batch_id}"

    def manifest(self) -> DataFrame:
        """run, batch_id, names and time of every committed batch; empty before the first."""
        none = self.spark.createDataFrame([], MANIFEST)
        try:
            return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{self.root}/_manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return none

    def is_committed(self, run: str, batch_id: int) -> bool:
        one = self.manifest().filter((F.col("run") == run) & (F.col("batch_id") == batch_id))
        return one.limit(1).count() > 0

    def commit(self, run: str, batch_id: int, names: Iterable[str]) -> None:
        """Make the folders of a batch visible, all of them at once."""
        entry = self.spark.range(1).select(
            F.lit(run).alias("run"),
            F.lit(batch_id).cast("bigint").alias("batch_id"),
            F.array(*[F.lit(n) for n in sorted(names)]).alias("names"),
            F.current_timestamp().alias("committed_at"),
        )
        entry.coalesce(1).write.mode("overwrite").json(f"{self.root}/_manifest/run={run}/batch_id={batch_id}")

    def runs(self) -> list[str]:
        """Runs with a committed batch, the one that began last at the end."""
        began = self.manifest().groupBy("run").agg(F.min("committed_at").alias("began"))
        return [r["run"] for r in began.orderBy("began", "run").collect()]

    def read(self, name: str, run: str | None = None) -> DataFrame:
        """Rows of one output with their ``run`` and ``batch_id``: of the newest run, or of ``run``."""
        if run is None:
            known = self.runs()
            if not known:
                raise ValueError(f"nothing is committed below {self.root}")
            run = known[-1]
        mine = self.manifest().filter((F.col("run") == run) & F.array_contains("names", name))
        paths = [self.path(name, run, r["batch_id"]) for r in mine.select("batch_id").orderBy("batch_id").collect()]
        if not paths:
            raise ValueError(f"{name} of run {run} is not committed")
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths)
