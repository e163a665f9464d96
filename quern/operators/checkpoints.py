"""Checkpoint metadata of branches: an append-only table, restored by key, whose forks carry their lineage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, branch_id string, global_step int, parent_branch_id string, fork_step int"
_KEY = ["run_id", "branch_id", "global_step"]


class Checkpoints:
    """A table of checkpoints in a folder that all executors share; each write appears at once, by the job's commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        """``run_id, branch_id, global_step, parent_branch_id, fork_step``; no rows before the first write."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def save(self, rows: DataFrame) -> None:
        """Writes rows whose key isn't stored; repeated rows count once, lineage columns may be missing."""
        for name in ("parent_branch_id", "fork_step"):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None))
        kinds = (part.split() for part in SCHEMA.split(", "))
        fresh = rows.select(*[F.col(name).cast(kind) for name, kind in kinds]).dropDuplicates(_KEY)
        fresh.join(self.table().select(*_KEY), _KEY, "left_anti").write.mode("append").parquet(self.path)

    def restore(self, run_id: str, branch_id: str, global_step: int) -> dict:
        """The metadata of one checkpoint; raises LookupError if there is none."""
        found = self.table().filter((F.col("run_id") == run_id) & (F.col("branch_id") == branch_id) & (F.col("global_step") == global_step)).head(1)
        if not found:
            raise LookupError(f"no checkpoint of {run_id}/{branch_id} at step {global_step}")
        return found[0].asDict()

    def ends(self) -> DataFrame:
        """``run_id, branch_id, earliest, latest, parent_branch_id`` of each branch."""
        return self.table().groupBy("run_id", "branch_id").agg(F.min("global_step").alias("earliest"), F.max("global_step").alias("latest"), F.max("parent_branch_id").alias("parent_branch_id"))

    def fork(self, parents: DataFrame, new: str) -> None:
        """Starts the branch ``new`` at ``fork_step`` of each ``run_id, branch_id``, which must have a checkpoint there."""
        stored = self.table().select(*_KEY)
        at = parents.select("run_id", "branch_id", F.col("fork_step").alias("global_step"))
        if at.filter(F.col("branch_id") == new).head(1) or stored.filter(F.col("branch_id") == new).join(at.select("run_id"), "run_id", "left_semi").head(1):
            raise ValueError(f"branch {new} exists")
        if missing := at.join(stored, _KEY, "left_anti").head(1):
            raise LookupError(f"no checkpoint to fork from: {missing[0].asDict()}")
        self.save(at.select("run_id", F.lit(new).alias("branch_id"), "global_step", F.col("branch_id").alias("parent_branch_id"), F.col("global_step").alias("fork_step")))
