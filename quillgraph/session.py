"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quillgraph")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory)
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows that go to a Python worker at once; texts can be long, and workers share an executor's memory.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone, bound what Python workers hold at once, and let them import this package.

    These are settings of the session that is given; a caller with other needs gives spark.newSession().
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset on a local master."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-quillgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_folders: list[str] = []


def clean_up(spark: SparkSession) -> None:
    """Delete all scratch tables of this process. Results that still read them must have been written before."""
    jvm = spark.sparkContext._jvm
    while _folders:
        place = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables written to the shared folder, to cut lineage and to read a result more than once.

    A lost executor costs a re-read of files, never a recomputation of all that went before. Loops
    drop what no later round reads; the rest stays until clean_up(), as results are lazy.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        _folders.append(self.base)

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def in_buckets(self, df: DataFrame, key: str) -> str:
        """The name of a table in buckets of a key, one file each; a join by that key does not shuffle it."""
        self.count += 1
        name, parts = f"kept_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(parts, key).write.bucketBy(parts, key).option("path", f"{self.base}/{self.count}").saveAsTable(name)
        return name

    def drop_buckets(self, name: str) -> None:
        """Forget such a table and delete its files."""
        self.drop(self.spark.table(name))
        self.spark.sql(f"DROP TABLE {name}")

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing reads any more."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.startswith(self.base) or self.base.split("://")[-1].lstrip("/") in path:
                jvm = self.spark.sparkContext._jvm
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
