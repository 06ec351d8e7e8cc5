"""Stage tables and lineage cuts (survey A2, A9).

A survey is a chain of stages; the reference persists each one as a file and
skips a stage whose file exists.  Here a stage is a Parquet table in the shared
folder named by ``spark.checkpoint.dir`` (never a machine-local folder on a
cluster): ``stage`` builds it only when its ``_SUCCESS`` marker is missing and
then reads it back, which also cuts the lineage, so an executor lost later does
not recompute earlier stages."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def _exists(spark: SparkSession, path: str) -> bool:
    """Does ``path`` exist on the (possibly distributed) file system?"""
    try:
        jvm = spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return bool(fs.exists(hpath))
    except Exception:  # noqa: BLE001 - no JVM handle (e.g. a Spark Connect session)
        return os.path.exists(path.removeprefix("file:"))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Is ``path`` a folder of the (possibly distributed) file system?"""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
    except Exception:  # noqa: BLE001 - no JVM handle (e.g. a Spark Connect session)
        return os.path.isdir(path.removeprefix("file:"))
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def write_stage(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """A2: write a stage table; ``mode='append'`` adds rows (the CSV header
    question of the reference does not arise for Parquet)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def stage(spark: SparkSession, name: str, build: Callable[[], DataFrame], root: str | None = None,
          fmt: str = "parquet") -> DataFrame:
    """Materialise-if-absent, then read back."""
    root = root or os.path.join(checkpoint_dir(spark), "stages")
    path = os.path.join(root, name)
    if not _exists(spark, os.path.join(path, "_SUCCESS")):
        # build under a private name, then publish with one rename: a reader
        # never sees a half-written stage, and two builders cannot interleave
        tmp = f"{path}.building-{uuid.uuid4().hex[:12]}"
        write_stage(build(), tmp, "overwrite", fmt)
        if not _rename(spark, tmp, path):
            path = tmp          # someone else published first; ours is just as good
    return spark.read.format(fmt).load(path)


def _rename(spark: SparkSession, src: str, dst: str) -> bool:
    try:
        jvm = spark.sparkContext._jvm
        s, d = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
        fs = s.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return bool(not fs.exists(d) and fs.rename(s, d))
    except Exception:  # noqa: BLE001 - no JVM handle: local file system
        try:
            os.rename(src.removeprefix("file:"), dst.removeprefix("file:"))
            return True
        except OSError:
            return False


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage: write ``df`` once as a Parquet table under the shared
    checkpoint folder and read it back.  (``DataFrame.checkpoint`` on an
    un-persisted plan computes it twice -- once to count, once to save.)"""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "cuts", f"{name}-{uuid.uuid4().hex[:16]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# --- stages keyed by what they are made of --------------------------------------------


#: Input files whose status is read one by one; of more the folders' (bytes, number of files, time) are read.
FILES = 2000


def _status(spark: SparkSession, path: str, folder: bool) -> list:
    """What tells one state of a file or folder from another: path, bytes, time of the last change (and files below a folder)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = fs.getFileStatus(p)
    if not folder:
        return [path, own.getLen(), own.getModificationTime()]
    below = fs.getContentSummary(p)
    return [path, below.getLength(), own.getModificationTime(), below.getFileCount()]


def fingerprint(df: DataFrame, *more: DataFrame, params: object = None) -> str:
    """A digest of what ``df`` is computed from: its analysed plan without the numbers that Spark deals out, the state
    of the files that it (and ``more`` frames, e.g. those in its subqueries) reads, and ``params``, which name what a plan's text does not show (functions,
    models, long lists).  The same computation over unchanged files has the same digest in every session.  Tables written by ``cut``
    are new in each run and do not count: name the frames that they come from in ``more``."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed().toString()
    plan = re.sub(r"#\d+L?|plan_id=\d+|\[id=#?\d+\]|@[0-9a-f]{4,}", "", plan)
    plan = re.sub(r"(?<=[A-Za-z_])_?lambda_\w+|\b(x|y|namedlambdavariable\w*)_\d+\b", "", plan)
    files = sorted({f for d in (df, *more) for f in d.inputFiles() if "/cuts/" not in f})
    if len(files) > FILES:
        states = [_status(spark, f, True) for f in sorted({os.path.dirname(f) for f in files})]
    else:
        states = [_status(spark, f, False) for f in files]
    return hashlib.sha256(json.dumps([plan, states, params], default=str).encode()).hexdigest()


class StageStore:
    """Stage tables that outlive the session that made them.

    A stage is valid for one fingerprint of its inputs and parameters, not because something bears its name.  It is written under a private
    name, with a manifest (name, fingerprint, rows by observation, time), and committed by one rename, so an interrupted build leaves no stage and
    the next run builds it again, while stages before it are reused.  A changed input or parameter changes the
    fingerprint of the first stage that depends on it; that one gets new files and so do all after it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.log: list[tuple[str, bool]] = []   # (stage, whether it was built by this store)

    def _path(self, name: str, key: str) -> str:
        return os.path.join(self.root, f"{name}-{key[:24]}")

    def manifest(self, path: str) -> dict | None:
        """The manifest of a committed stage."""
        if not _exists(self.spark, os.path.join(path, "manifest", "_SUCCESS")):
            return None
        return json.loads(self.spark.read.text(os.path.join(path, "manifest")).first()[0])

    def stage(self, name: str, df: DataFrame, *inputs: DataFrame, params: object = None) -> DataFrame:
        """The stage table of ``df``; built only where no committed one has this fingerprint."""
        key = fingerprint(df, *inputs, params=params)
        path = self._path(name, key)
        found = self.manifest(path)
        valid = found is not None and found["key"] == key
        if not valid:
            seen = Observation(f"stage-{name}")
            building = f"{path}.building-{uuid.uuid4().hex[:12]}"
            write_stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), os.path.join(building, "data"))
            about = {"name": name, "key": key, "rows": seen.get["rows"], "written": time.time(), "schema": df.schema.simpleString()}
            self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(os.path.join(building, "manifest"))
            if not _rename(self.spark, building, path) and self.manifest(path) is None:
                path = building
        self.log.append((name, not valid))
        return self.spark.read.schema(df.schema).parquet(os.path.join(path, "data"))

    def counts(self) -> DataFrame:
        """E3 without a further job over the data: stage, rows of every stage that this store built or reused, from the manifests."""
        names = [n for n, _ in self.log]
        rows = {}
        for path in _children(self.spark, self.root):
            if ".building-" not in path and (m := self.manifest(path)) is not None and m["name"] in names:
                if m["name"] not in rows or m["written"] > rows[m["name"]]["written"]:
                    rows[m["name"]] = m
        return self.spark.createDataFrame([(n, rows[n]["rows"]) for n in dict.fromkeys(names)], "stage string, n_rows long")


def _children(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []
