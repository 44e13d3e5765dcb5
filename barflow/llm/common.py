"""Helpers shared by the training-data operators: tables in the shared folder, native
let-bindings and running sums, connected components, and slicing of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset a session of one machine gets a fresh folder; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, options: dict[str, int] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag)
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """Names for ``n`` helper columns that no column of ``df`` has, however it is spelled."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"_h{k}" not in taken:
            out.append(f"_h{k}")
        k += 1
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``, also inside its lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indices(n: Column) -> Column:
    """1..n, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def running_sum(values: Column, block: int = 256) -> Column:
    """Sums of all elements before each one (array<bigint>). Two levels, so that long arrays aren't copied per element."""

    def within(xs: Column, first: Column) -> Column:
        start = F.struct(first.cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(
            xs,
            start,
            lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.array_append(acc["a"], acc["s"]).alias("a")),
            lambda acc: acc["a"],
        )

    def blocks(xs: Column) -> Column:
        parts = F.transform(indices(F.ceil(F.size(xs) / block)), lambda i: F.slice(xs, (i - 1) * block + 1, block))
        return let(
            parts,
            lambda ps: let(
                within(F.transform(ps, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0)),
                lambda firsts: F.flatten(F.zip_with(ps, firsts, within)),
            ),
        )

    return let(F.transform(values, lambda x: x.cast("bigint")), blocks)


#: State of this Python worker: the cache of the operator that runs now, and of no other.
_STATE: dict[object, object] = {}


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What ``make`` builds, kept for later tasks of this worker until another operator asks for its own."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of this session hold about ``most`` bytes at most: whole texts go by size, not by number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Within, Arrow batches of what is run hold about ``most`` bytes at most; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def wide_rows(spark: SparkSession, most: int = 4 << 20, rows: int = 64) -> Iterator[None]:
    """Within, tables whose rows are large are run in small batches: Arrow batches of about ``most`` bytes, Parquet's of ``rows`` rows, which has no bound in bytes."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        with arrow_batches(spark, most):
            yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; one row is never split."""
    start = total = 0
    lengths = batch.column(batch.schema.get_field_index(column))
    for i, n in enumerate(pa.compute.binary_length(lengths).to_pylist()):
        if total and total + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def components(edges: DataFrame, tag: str = "cc", most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(u, v)`` by alternating large-star and small-star steps.

    Returns ``(node, component)`` for every node of an edge, the component being its smallest node.
    Self-loops are ignored; repeated edges count once. Each round is written to the shared folder;
    the neighbour minima are their own table, so that joins on a hub can be split at run time.
    """
    e = written(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        tag,
    )
    seen = None
    for _ in range(most_rounds):
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == seen:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), tag)
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, tag)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), tag)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
