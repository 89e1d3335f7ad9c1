"""What the operators of this folder share: places for tables, batches of texts, groups of rows."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import find_package

#: Rows and bytes of an Arrow batch: texts may be long, so a batch is far smaller than Spark's default.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package, and keeps their batches small."""
    find_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def rested(spark: SparkSession) -> SparkSession:
    """prepare(), once every executor has collected its garbage and handed the heap that this frees back.

    A heap grows towards its limit from one stage to the next and keeps what it took, beside which Python
    workers have to find room. A task a core reaches all executors; calls that meet in one are one collection.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Where none is set, a session in one process makes a local one, and any other is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = tempfile.mkdtemp(prefix="weftspan-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: what follows doesn't recompute it if an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for t in tables:
        if (path := getattr(t, "table_path", None)) is not None:
            spark = t.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """These columns only, so that no other column's name can clash; an absent one is null."""
    have = {c.lower(): c for c in reversed(df.columns)}
    return df.select(*[df[f"`{have[n]}`"].alias(n) if n in have else F.lit(None).alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_hash(rows: DataFrame, rows_in_all: int, want: int) -> DataFrame:
    """About twice `want` rows of a table of `rows_in_all`, all those of it with a low hash of doc_id, in `place`."""
    parts = 1 << 30
    bound = min(parts, int(parts * 2.0 * want / max(1, rows_in_all)) + 1)
    return rows.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).where(F.col("place") < bound)


def first_by_hash(rows: DataFrame, rows_in_all: int, want: int) -> DataFrame:
    """At most `want` rows of a few numbers, the first by a hash of doc_id; only about twice as many are sorted."""
    return by_hash(rows, rows_in_all, want).orderBy("place", "doc_id").limit(want).drop("place")


def sample(rows: DataFrame, want: int, most_bytes: int, group: str | None = None) -> list:
    """Of rows with place, doc_id and text at most `want`, and `most_bytes` of their texts, by place; of each value of `group`.

    Rows are written first, so that the texts that come to the driver are chosen by their sizes alone. The sample ends
    where the sum of bytes exceeds the bound; only a text that exceeds it alone is passed over. Equal texts of an id count as one.
    """
    keep = [group] if group else []
    some = written(rows.where("text IS NOT NULL").withColumn("bytes", F.octet_length("text")).withColumn("mark", F.xxhash64("text")))
    one = Window.partitionBy(*keep).orderBy("place", "doc_id", "mark")
    # about twice `want` rows of a few numbers are left of each group by now
    small = some.where(F.col("bytes") <= most_bytes).select(*keep, "place", "doc_id", "mark", "bytes").distinct()
    fits = small.withColumn("number", F.row_number().over(one)).where(F.col("number") <= want)
    fits = fits.withColumn("sum", F.sum("bytes").over(one.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= most_bytes)
    chosen = fits.select(*keep, "doc_id", "mark")
    found = some.join(F.broadcast(chosen), [*keep, "doc_id", "mark"]).dropDuplicates([*keep, "doc_id", "mark"]).orderBy(*keep, "place", "doc_id", "mark").collect()
    forget(some)
    return found


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """doc_id and the label (0 or 1) of ids that have one; what has both is not learned from."""
    marked = columns(labels, "doc_id", name).where(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1))
    return marked.groupBy("doc_id").agg(F.min(name).alias(name), F.max(name).alias("most")).where(F.col(name) == F.col("most")).select("doc_id", name)


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Hands what this process has freed back to the system, which the allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; a worker outlives its task and waits for other stages' tasks, so what the task took is given back at its end."""

    def leaning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return leaning


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """make() runs once a task and returns what turns a batch into a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = make()
        for batch in batches:
            if batch.num_rows and (out := turn(batch)) is not None:
                yield out

    return df.mapInArrow(lean(run), schema)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Tables of the rows of each key, of batches sorted by the key."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = batch.column(key).to_pylist()
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[start]:
                if kept and values[start] != last:
                    yield last, pa.Table.from_batches(kept)
                    kept = []
                kept.append(batch.slice(start, i - start))
                last = values[start]
                start = i
    if kept:
        yield last, pa.Table.from_batches(kept)
