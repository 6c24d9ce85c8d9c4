"""What several training-data operators need of Spark: staged tables, one row per id, batches of bounded size."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a task holds as arrays at once; a longer single text is still taken whole.
CHUNK_BYTES = 1 << 19
BATCH_ROWS = 500
#: Bits of the marks by which rows are chosen before a join: 2 MB.
MARK_BITS = 1 << 24
#: Folders of sessions without executors of their own, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. A temporary folder only where all tasks run in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = _LOCAL.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="spark-stage-")
        _LOCAL[context.applicationId] = path
    return path.rstrip("/")


class Scratch:
    """Tables of one run of an operator in the shared folder, deleted when nothing will read them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[str, list[str]] = {}
        self._made = 0

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """df, written as Parquet and read again: cuts lineage, survives lost executors."""
        path = f"{self.folder}/{name}-{self._made}"
        self._made += 1
        df.write.parquet(path)
        self._paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes what was staged under these names; frames that are still to be computed must not read it."""
        for name in names:
            for path in self._paths.pop(name, []):
                self._delete(path)

    def keep(self, *names: str) -> None:
        """Deletes all but what was staged under these names."""
        self.drop(*[n for n in self._paths if n not in names])

    def clear(self) -> None:
        self._paths.clear()
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in the shared folder, for results that outlive the call."""
    return Scratch(df.sparkSession, name).stage(df, "table")


def one_row_per_id(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row for each key; of several the one whose text sorts first (a null text last), then by its other columns.

    Rows with a null key are left as they are. Only rows of repeated keys are shuffled; without any, docs is returned.
    """
    repeated = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(key).alias("__key"))
    if repeated.isEmpty():
        return docs
    comparable = [f.name for f in docs.schema if f.name not in (key, text) and f.dataType.typeName() not in ("map", "variant")]
    order = F.struct(F.col(text).isNull().alias("no_text"), F.col(text).alias("text"), *[F.col(f"`{c}`") for c in comparable])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = docs.join(repeated, F.col(key) == F.col("__key"), "left_semi").groupBy(F.col(key).alias("__group")).agg(F.min_by(whole, order).alias("__row"))
    single = docs.join(repeated, F.col(key) == F.col("__key"), "left_anti")
    return single.unionByName(first.select("__row.*"))


def perhaps_in(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """df with __perhaps: false only where df's key is none of those in ids' first column; an exact join decides the others.

    So that a join by which few rows are found doesn't shuffle all texts. The marks are a bitmap of hashes: MARK_BITS at most, whatever the
    number of ids, sent to all tasks; with more ids more rows are true that needn't be.
    """
    kind = df.schema[key].dataType

    def place(column: Column) -> tuple[Column, Column]:
        bit = F.pmod(F.xxhash64(column.cast(kind)), F.lit(MARK_BITS))
        return F.shiftright(bit, 15).alias("__block"), F.pmod(bit, F.lit(1 << 15)).alias("__bit")

    marks = ids.select(*place(F.col(ids.columns[0]))).repartition("__block").groupBy("__block").agg(F.bitmap_construct_agg("__bit").alias("__marks"))
    block, bit = place(F.col(key))
    held = df.withColumns({"__block": block, "__bit": bit}).join(F.broadcast(marks), "__block", "left")
    byte = F.conv(F.hex(F.expr("substring(__marks, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    set_ = F.expr("shiftleft(1, cast(__bit % 8 as int))")
    return held.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(byte.bitwiseAND(set_) != 0, F.lit(False)).alias("__perhaps"))


def with_id_in(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of df whose key is in ids' first column."""
    some = perhaps_in(df, ids, key).where("__perhaps").drop("__perhaps")
    return some.join(ids.select(F.col(ids.columns[0]).alias("__id")).distinct(), F.col(key) == F.col("__id"), "left_semi")


def without_id_in(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of df whose key is not in ids' first column; rows with a null key stay."""
    marked = perhaps_in(df, ids, key)
    some = marked.where("__perhaps").drop("__perhaps")
    rest = some.join(ids.select(F.col(ids.columns[0]).alias("__id")), F.col(key) == F.col("__id"), "left_anti")
    return marked.where("NOT __perhaps").drop("__perhaps").unionByName(rest)


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches were bounded to BATCH_ROWS rows, unless the session names a number of its own.

    Ten thousand whole texts, the default, can be more than a Python worker has room for; Spark has no such setting for one query.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name, "10000") == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one, or when the reader stops, the memory that the task no longer needs goes back to the system.

    Spark keeps a worker for other tasks, and there are more of them than tasks at a time: each would go on holding the most that it ever had.
    """
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # arrays of numpy; only the GNU library keeps them
        if trim:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with about `size` bytes of text each, and their texts (null as empty); one part's texts are held at a time."""
    for batch in tidied(batches):
        low = held = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for i, n in enumerate([*lengths, size + 1]):
            if i == len(lengths) or held and held + n > size:
                if i > low:
                    part = batch.slice(low, i - low)
                    yield part, [t or "" for t in part.column(text).to_pylist()]
                low, held = i, 0
            held += n + 64


def item_blocks(items: DataFrame, words: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of items (item_id, text) in order, in blocks of about `words` words; null texts are left out; the driver holds one block."""
    ids, texts, held = [], [], 0
    for r in items.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        held += len(r["text"].split())
        if held >= words:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts
