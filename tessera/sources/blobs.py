"""Which blobs are referenced, and how large they are: by content hash, never the bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
SCHEMA = "hash binary, version int, size long, at long"


@dataclass(frozen=True)
class BlobIndex:
    """Records and tombstones (a null size), each with the time of its writing.

    A retraction is kept, so that it outlives a merge with an older index; putting the blob
    again brings it back.
    """

    df: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> BlobIndex:
        return BlobIndex(spark.createDataFrame([], SCHEMA))

    def _add(self, rows: DataFrame) -> BlobIndex:
        now = self.df.agg(F.coalesce(F.max("at"), F.lit(0)).alias("now"))  # a row
        own = rows.crossJoin(F.broadcast(now)).select("hash", F.lit(VERSION).alias("version"), "size", (F.col("now") + 1).alias("at"))
        return self.merged(BlobIndex(own))

    def put(self, blobs: DataFrame) -> BlobIndex:
        """(hash, size) rows; what is there already stays as it is."""
        own = blobs.select("hash", F.col("size").cast("long").alias("size")).dropDuplicates(["hash"])
        return self._add(own.join(self.list().select("hash", "size"), ["hash", "size"], "left_anti"))

    def retract(self, hashes: DataFrame) -> BlobIndex:
        return self._add(hashes.select("hash").distinct().withColumn("size", F.lit(None).cast("long")))

    def merged(self, other: BlobIndex) -> BlobIndex:
        """Of each blob what was written last; a retraction stands against a record of the same time."""
        both = self.df.unionByName(other.df)
        last = F.max_by(F.struct("version", "size", "at"), F.struct("at", F.col("size").isNull().alias("gone")))
        return BlobIndex(both.groupBy("hash").agg(last.alias("r")).select("hash", "r.*"))

    def get(self, hash: bytes) -> DataFrame:
        """(version, size) of a blob, or no row."""
        return self.list().where(F.col("hash") == F.lit(hash)).select("version", "size")

    def has(self, hash: bytes) -> bool:
        return not self.get(hash).isEmpty()

    def list(self) -> DataFrame:
        """(hash, version, size) of every referenced blob."""
        return self.df.where("size is not null").select("hash", "version", "size")
