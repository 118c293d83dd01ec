"""Scratch tables in the cluster's shared folder, and skew helpers.

Iterative operators cut their lineage by writing a table below the folder that
``spark.checkpoint.dir`` names.  Such a table outlives any executor.  Only where
the setting is absent and the master is local (tests, a laptop) a local temporary folder
stands in; on a cluster the setting must be there.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's scratch tables."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="weft-")
        root = f"{base.rstrip('/')}/weft-{app}-{uuid.uuid4().hex[:8]}"
        _made[app] = root

        def clean() -> None:
            try:
                _delete(spark, root)
            except Exception:  # the session may be gone already
                local = root.removeprefix("file://")
                if os.path.isdir(local):
                    import shutil

                    shutil.rmtree(local, ignore_errors=True)

        atexit.register(clean)
    return _made[app]


class Scratch:
    """Scratch tables of one operator call; ``drop`` frees those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
        self._n = 0
        self._path: dict[int, tuple[str, DataFrame]] = {}  # holding the table keeps its id from being given again

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it back: a cut of the lineage that survives executors."""
        path = f"{self.root}/{self._n}"
        self._n += 1
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._path[id(back)] = (path, back)
        return back

    def path(self, df: DataFrame) -> str:
        """The folder of a table made by ``write``."""
        return self._path[id(df)][0]

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by ``write`` that nothing reads any more."""
        path, _ = self._path.pop(id(df), (None, None))
        if path:
            _delete(self.spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot if it holds more than this share of the rows, so there are at most HOT_KEYS hot keys.
HOT_KEYS = 512


def hot_keys(counts: DataFrame, key: str, count: str, total: int, floor: int = 20_000) -> list:
    """Keys with more than ``total / HOT_KEYS`` (and ``floor``) rows: at most HOT_KEYS values, so safe on the driver."""
    least = max(floor, total // HOT_KEYS)
    return [r[0] for r in counts.where(F.col(count) > F.lit(least)).select(key).collect()]


def looked_up(left: DataFrame, key: str, right: DataFrame, by: str, hot: list, how: str = "inner") -> DataFrame:
    """``left`` with the row of ``right`` that has its key; ``right`` has one row per key, those of ``hot`` keys (at most HOT_KEYS) go by broadcast."""
    if not hot:
        return left.join(right, F.col(key) == F.col(by), how)
    few = right.where(F.col(by).isin(hot))
    cold = left.where(~F.col(key).isin(hot)).join(right, F.col(key) == F.col(by), how)
    return cold.unionByName(left.where(F.col(key).isin(hot)).join(F.broadcast(few), F.col(key) == F.col(by), how))


def fits_broadcast(df: DataFrame, max_bytes: int = 8 << 20, row_overhead: int = 32) -> bool:
    """Whether a (cheap to scan) table is under ``max_bytes``, measured, not guessed."""
    size = F.lit(row_overhead)
    for name, kind in df.dtypes:
        size = size + (F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) if kind in ("string", "binary") else F.lit(8))
    got = df.agg(F.sum(size)).first()[0]
    return (got or 0) <= max_bytes
