"""Intermediate tables that all executors can read, and size checks in front of broadcasts.

Results that are read more than once are written as Parquet under the folder named by ``spark.checkpoint.dir``, which
every executor shares. Losing an executor therefore never loses a result that a later step depends on.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.shipping import ship

#: The temporary folder of each application that has no shared one.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and one machine does all the work, as in tests. An error on a cluster, where executors wouldn't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="larkspan-"))
    return found.rstrip("/")


class Workspace:
    """A folder of its own within the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{re.sub('[^a-z0-9]+', '-', name.lower())}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the files."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows: the size check in front of a broadcast."""
    return df.limit(rows + 1).count() <= rows


def lookup(df: DataFrame, rows: int = 100_000, size: int = 64 << 20) -> DataFrame:
    """Mark a table for broadcast if it is checked to be small; otherwise leave the join to shuffle.

    Rows are checked, and their bytes where a column's width isn't fixed.
    """
    if not at_most(df, rows):
        return df
    wide = [c for c, t in df.dtypes if t in ("string", "binary") or t.startswith(("array", "map", "struct"))]
    if wide:
        length = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string") if t not in ("string", "binary") else F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if c in wide), F.lit(0))
        if (df.agg(F.sum(length.cast("long"))).first()[0] or 0) > size:
            return df
    return F.broadcast(df)
