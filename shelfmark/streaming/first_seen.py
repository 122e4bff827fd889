"""First-seen hits across runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark import schemas
from shelfmark.operators import dedup
from shelfmark.session import stage, staging

ARRIVAL = ["seen_at", *dedup.ARRIVAL]


def hit_stream(spark: SparkSession, landing_dir: str) -> DataFrame:
    return spark.readStream.schema(schemas.HITS).json(landing_dir)


class FirstSeen:
    """Keys that were seen, and the hits that were first, in a folder of their own.

    Nothing expires: a key counts as new until it is stored, however late its hit arrives.
    Every batch writes a directory named by its number, so a batch that is replayed writes
    the same again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def firsts(self) -> DataFrame:
        """Every key with its first hit, in order of batches."""
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.HITS.fields)
        return self._read("firsts", f"batch long, hit_key string, n_seen long, {columns}")

    def rejected(self) -> DataFrame:
        """How many hits of each batch lacked a required field."""
        return self._read("rejected", "batch long, n long")

    def add(self, hits: DataFrame, batch: int) -> None:
        """Store the first hit of every key that no earlier batch holds.

        Stored keys are filtered by the batch's keys first, which are few: Spark broadcasts them,
        and the history is read where it lies instead of being shuffled.
        """
        with staging(self.spark):
            self._add(stage(hits.select(*schemas.HITS.names), "hits"), batch)

    def fresh(self, hits: DataFrame, batch: int) -> DataFrame:
        new = stage(dedup.first_seen(hits.filter(dedup.has_required_fields()), arrival=ARRIVAL), "new-keys")
        known = self.firsts().filter(F.col("batch") < batch).select("hit_key")
        seen = known.join(new.select("hit_key"), "hit_key", "left_semi")
        return new.join(seen, "hit_key", "left_anti").select("hit_key", "n_seen", *schemas.HITS.names)

    def _add(self, hits: DataFrame, batch: int) -> None:
        fresh = self.fresh(hits, batch)
        fresh.write.mode("overwrite").parquet(f"{self.root}/firsts/batch={batch}")
        lacking = hits.filter(~dedup.has_required_fields()).agg(F.count("*").alias("n"))
        lacking.write.mode("overwrite").parquet(f"{self.root}/rejected/batch={batch}")

    def run(self, hits: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take all hits that arrived since the last run, then stop."""
        return hits.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
