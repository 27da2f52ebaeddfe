"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.session import cut_lineage


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python
    workers import it to run the functions below."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "flowloom_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.relpath(file, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns _c0, _c1, ..., so that no name of the caller's clashes
    with a helper column, and the new name of each column."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def given_back(names: dict[str, str], without: Iterable[str] = ()) -> list:
    """The columns of :func:`renamed` under their own names, but for those that a result of the same name replaces."""
    gone = {c.lower() for c in without}
    return [F.col(new).alias(c) for c, new in names.items() if c.lower() not in gone]


def give_memory_back() -> None:
    """What Arrow and the C library hold for reuse goes back to the system. Workers outlive
    their tasks, and freed arrays of up to 32 MB otherwise stay with them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors. A task gives the
    memory that is held for reuse back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_memory_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def at_most(spark: SparkSession, rows: int) -> None:
    """From now on tasks get at most ``rows`` rows at once: for results with long rows that a
    caller runs later. 10,000 documents take tens of MB off the heap in both processes of a task."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside the block, tasks get at most ``rows`` rows at once: for jobs whose rows are long."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes a piece.

    A row longer than the limit makes a piece of its own, so memory follows the
    longest row and not the row count of a batch.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for at, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def release(*tables: DataFrame) -> None:
    """Delete written stages that nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/stage-" not in folder:
                continue
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: ``node``, ``component``.

    Alternates two star contractions, each a shuffle by node: every node sends
    its larger neighbours, then its smaller ones, to the smallest node it knows.
    Edge count never grows beyond the input and the number of rounds follows the
    logarithm of the longest path. Only a row count reaches the driver.
    Endpoints are integers; rows with a NULL endpoint are ignored. Nodes without
    an edge to another node are not returned: they are their own component.
    """
    now = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours above a node move to the smallest one around it.
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, cut_lineage(small)
        release(before)
        # Every node is a leaf of one star, or a centre: nothing can move any more. Leaves
        # and centres are counted, not joined: a broadcast join by two columns takes a
        # whole memory page on every executor, however few its rows.
        roles = now.select(F.explode(F.array(
            F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf")))).alias("r"))
        ends = roles.groupBy("r.node").agg(F.sum("r.leaf").alias("_up"), F.count("*").alias("_n"))
        if not ends.where("_up > 1 OR (_up = 1 AND _n > 1)").limit(1).count():
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
