"""Reading tables, cutting lineage and grouping links; shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders written by ``settle`` in this session, for ``sweep``.
_SCRATCH: list[str] = []
#: The temporary folder that serves in local mode where none is set.
_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves in local mode only; on a cluster a machine's
    own folder would be invisible to the other machines, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-sievemill-"))
        found = _OWN[0]
    return found.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and return it as read from there.

    Cuts the lineage, survives lost executors, and lets later readers take single columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievemill/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _SCRATCH.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete what ``settle`` wrote in this session, once the results that read it are written."""
    jvm = spark._jvm
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, label: str) -> DataFrame:
    """Connected components of ``links`` (a long, b long): one row (id, component) per node.

    ``component`` is the smallest id reachable. Labels spread over the links and then jump to
    the label of their label, so rounds grow with the logarithm of a component's diameter. All
    work is joins and aggregates; each round is written out. Null ends are left out.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = settle(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{label}-links")
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), f"{label}-labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        to = labels.select(F.col("id").alias("mid"), F.col("component").alias("jump"))
        labels = settle(spread.join(to, "mid").select("id", "old", F.least("mid", "jump").alias("component")), f"{label}-labels")
        if labels.where("old <> component").isEmpty():
            return labels.select("id", "component")
