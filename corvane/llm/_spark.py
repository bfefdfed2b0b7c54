"""Spark helpers of the operators: tables in the shared folder, and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where none is named, a temporary one of this machine if the master
    runs in this process (as in tests); a cluster must name one that all its machines see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Rows of one Arrow batch where the session does not say otherwise: a worker holds a few batches at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows that Python workers hold at a time, unless the session sets its own bound."""
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, str(BATCH_ROWS))


class Tables:
    """Intermediate tables of one run in the shared folder.

    A written table cuts lineage and survives lost executors.  ``drop`` removes a table once nothing reads it.  With
    ``tidy``, each write also frees the shuffle files of what ended: for operators of a few large steps.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = True):
        self.spark, self.root = spark, f"{shared_folder(spark)}/corvane-{name}-{uuid.uuid4().hex}"
        self.count, self.tidy = 0, tidy
        small_batches(spark)

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        if self.tidy:
            self.forget()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._corvane_path = path
        return out

    def forget(self) -> None:
        """Lets the driver collect plans that ended, so that executors delete the shuffle files of those."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            if not hasattr(table, "_corvane_path"):
                continue
            path = jvm.org.apache.hadoop.fs.Path(table._corvane_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(tables: Tables, links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``links`` (a, b), by alternating
    large-star and small-star steps (Kiveris et al. 2014), each with shuffles of links only.

    Each round costs two group-bys; a node's neighbour list is never gathered, only its minimum.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = tables.write(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every neighbour larger than a node hangs on the node's smallest
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = tables.write(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        tally = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        same = tally(edges) == tally(after)
        tables.drop(edges)
        edges = after
        if same:
            break
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return tables.write(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots))
