"""The F5 cascade kept up to date batch by batch (survey F5, M4, K2).

The state is a narrow table: ``ord``, the digests of the cascade's keys, and which steps a row survives.  It is append-only: each
batch adds a version with the rows that are new or whose flags changed, and a row's last version holds.  Merging a batch touches only the
key groups that can change -- the batch's DOIs, then the titles of the rows whose first flag changed, then the abstracts of
those whose second did -- and a row that survived may be retracted because one with a smaller ``ord`` has come, just as a row
that lost to it may come back.  After every batch the survivors are those of ``remove_repeated`` over all rows so far, in whatever order
they came.

Batches are numbered; a batch that is merged again replaces its own version, so a replayed micro-batch changes nothing.  Rows whose
``ord`` the state already has are left out.  NULL keys are as in F5: rows without a DOI all pass, rows without a title are one group.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import _exists, cut
from .dedup import _cascade_keys, _narrow

KEYS = ["__doi", "__title", "__abstract", "__text"]
FLAGS = ["s1", "s2", "s3"]
SCHEMA = "ord long, __doi string, __title binary, __abstract binary, __text boolean, s1 boolean, s2 boolean, s3 boolean, was boolean, batch long"


class IncrementalCascade:
    """The state of one growing table under ``root``."""

    def __init__(self, spark: SparkSession, root: str, order_by: str = "ord"):
        self.spark, self.root, self.order_by = spark, root, order_by

    def _path(self, batch_id: int | None = None) -> str:
        top = os.path.join(self.root, "versions")
        return top if batch_id is None else os.path.join(top, f"batch={batch_id}")

    def versions(self, before: int | None = None, spark: SparkSession | None = None) -> DataFrame:
        """Every version of every row, of the batches before one."""
        spark = spark or self.spark
        if not _exists(spark, self._path()):
            return spark.createDataFrame([], SCHEMA)
        rows = spark.read.schema(SCHEMA).parquet(self._path())
        return rows if before is None else rows.filter(F.col("batch") < before)

    @staticmethod
    def last(versions: DataFrame) -> DataFrame:
        """The rows as they are now."""
        now = versions.groupBy("ord").agg(F.max_by(F.struct(*KEYS, *FLAGS), "batch").alias("v"))
        return now.select("ord", "v.*")

    def merge(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Merge the rows of a batch; returns ord, change (``added`` or ``retracted``) of the survivors that it changed."""
        old = self.versions(batch_id, batch.sparkSession)
        narrow = _narrow(batch, self.order_by, **_cascade_keys("all")).withColumnRenamed(self.order_by, "ord").dropDuplicates(["ord"])
        new = narrow.join(old.select("ord"), "ord", "left_anti")
        new = cut(new.select(F.col("ord").cast("long").alias("ord"), *KEYS).withColumns({f: F.lit(False) for f in FLAGS} | {"was": F.lit(False), "fresh": F.lit(True)}), "batch")

        changed = new
        for step, (key, flag, given) in enumerate((("__doi", "s1", F.lit(True)), ("__title", "s2", F.col("s1")), ("__abstract", "s3", F.col("s2") & F.col("__text")))):
            group = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"))  # a NULL is a group, but for DOIs
            keyed = changed.filter([F.col(key).isNotNull(), F.lit(True), F.col("__text")][step])
            touched = keyed.select(group.alias("g")).distinct()
            at = old.withColumn("g", group).join(touched, "g", "left_semi").drop("g", "was")
            here = self.last(at).withColumns({"was": F.col("s3"), "fresh": F.lit(False)}).join(changed.select("ord"), "ord", "left_anti")
            rows = here.unionByName(changed).withColumn("g", group)
            least = rows.filter(given).groupBy("g").agg(F.min("ord").alias("least"))
            first = given & (F.col("ord") == F.col("least"))
            if step == 0:
                first = F.col(key).isNull() | first
            judged = rows.join(least, "g", "left").withColumn("now", F.coalesce(first, F.lit(False))).drop("g", "least")
            moved = judged.filter(F.col("fresh") | (F.col("now") != F.col(flag))).withColumn(flag, F.col("now")).drop("now")
            kept = judged.filter(~F.col("fresh") & (F.col("now") == F.col(flag))).drop("now").join(changed.select("ord"), "ord", "left_semi")
            changed = cut(moved.unionByName(kept), f"step-{step}")
        # the rows of a batch are all written, also those that survive nothing: a later batch may let them come back
        changed.select("ord", *KEYS, *FLAGS, "was").write.mode("overwrite").parquet(self._path(batch_id))
        return (changed.filter(F.col("was") != F.col("s3"))
                .select("ord", F.when(F.col("s3"), "added").otherwise("retracted").alias("change")))

    def survivors(self) -> DataFrame:
        """ord of the rows that the cascade keeps of all batches so far."""
        return self.last(self.versions()).filter("s3").select("ord")

    def select(self, records: DataFrame) -> DataFrame:
        """The rows of ``records`` that survive."""
        return records.join(self.survivors().withColumnRenamed("ord", self.order_by), self.order_by, "left_semi")
