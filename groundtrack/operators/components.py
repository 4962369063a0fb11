"""Connected components of links, and the cuts of lineage that steps in rounds need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a fresh local one with a local
    master, which is one machine; an error on a cluster, whose executors do not share such a folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to shared storage and read back, so lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a table may be sent to every executor.
FEW = 100_000


def sized(df: DataFrame, n: int | None = None, few: int = FEW) -> DataFrame:
    """A table for a join, told how to be joined by its counted rows (`n` at most, where known; else it is
    cut and counted): sent to every executor when there are few, else merged.

    Sizes that Spark reckons say little here: files are compressed, and rows that are exploded count as one."""
    if n is None:
        df = cut(df)
        n = df.count()
    return df.hint("broadcast" if n <= few else "merge")


def bundle(rows: int, *keys: str, most: int = 20_000) -> Column:
    """A number for some `most` rows by a hash of their keys: small groups that need no other share a
    call, which costs more than a group of few rows."""
    return F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-rows // most))))


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a cut that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Columns a, b (long) are links; returns node and the smallest node it reaches, as component.

    Alternates large-star and small-star steps, each an aggregate and a join on the node, until the
    links no longer change; then every link leads to the smallest node. Each round is cut.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        star = star.join(least, "a")
        star = star.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = cut(star)
        state = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        drop_cut(now)
        now = after
        if tuple(state) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = tuple(state)
