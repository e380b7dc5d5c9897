"""What several operators share: shared storage, Arrow helpers, components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import pickle
import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of a word, as bytes: space and \t \n \v \f \r.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


#: Most bytes and rows of an Arrow batch, where the session has Spark's defaults: batches of whole texts must fit into memory whatever texts are long.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "4m"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "4096")}


def bound_batches(spark: SparkSession) -> SparkSession:
    """Makes the session's Arrow batches small, unless it has bounds of its own."""
    for key, (usual, small) in BATCH.items():
        if re.sub("[a-z]+$", "", spark.conf.get(key, usual).lower()) in (usual, "64"):
            spark.conf.set(key, small)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master, as in tests, may fall back on a temporary folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path is None and sc.getCheckpointDir() is not None:
        path = sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparrowlog-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _remove(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def drop_path(spark: SparkSession, path: str) -> None:
    _remove(spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and outlives any executor."""
    spark = bound_batches(df.sparkSession)
    path = f"{shared_dir(spark)}/sparrowlog-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path_of_it = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no later plan reads."""
    for df in tables:
        drop_path(df.sparkSession, df.path_of_it)


def _give_back() -> None:
    """Returns freed memory to the system: workers stay alive between stages, and those of two kinds of kernels beside each other."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A kernel over batches that gives its memory back when it ends."""

    def over(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return over


def tidy_group(run):
    """The same for a kernel over groups, after those of some size."""

    def over(t):
        try:
            return run(t)
        finally:
            if t.nbytes > 1 << 22:
                _give_back()

    return over


def sent(spark: SparkSession, model):
    """A broadcast of a model of this package, class and all, for executors that lack the package; call it in a task."""
    bound_batches(spark)
    data = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(data.value)


def with_text(docs: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, int, str]:
    """What a kernel reads: ``keep``'s columns and the text, sent once; where the text stands; and the kept columns' types."""
    names = list(keep)
    df = docs.select(*names) if text in names else docs.select(*names, F.col(text).alias("text_of_it"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes[: len(names)])
    return df, names.index(text) if text in names else len(names), kinds


def release(spark: SparkSession) -> None:
    """Shuffle files go once the driver has collected the plans that made them; a long job asks for that between its parts."""
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` with the smallest node it reaches.

    Alternates large-star and small-star steps, each a grouped minimum, until
    a round changes nothing.  Rounds grow with the logarithm of a path's
    length.  Every round is a written table; the driver sees one count a round.
    """
    e = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = written(e, "edges")
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), "edges")
        discard(e)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small = written(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(large)
        same = small.groupBy("u").count().where("count > 1").isEmpty()
        if same and small.join(small.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            e = small
            break
        e = small
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
