"""Written intermediate tables, and Arrow helpers that all operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which the shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder will do as
    long as all run on one machine; a cluster must name a shared one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs a reread, not a rerun.

    ``keep`` writes a DataFrame and reads it back; the shuffle files of the write go when it ends. ``drop`` deletes tables
    that no later plan reads. What a returned, lazy DataFrame still reads is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self._files(self.root, lambda fs, path: fs.mkdirs(path) and fs.deleteOnExit(path))

    def _files(self, path: str, use) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        use(at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = path = f"{self.root}/{name}"
        was = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._files(self.paths.pop(name), lambda fs, path: fs.delete(path, True))


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with ``row``, a number of its own for each row that rises with doc_id: doc_id itself where it is unique.

    Where ids repeat or are null, rows are sorted by id and text (null ids last) over range partitions and written; their
    place in that order is the number. As many counts as there are partitions come to the driver."""
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").limit(1).count():
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    place = F.monotonically_increasing_id()  # the partition's number, then 33 bits
    sorted_ = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = scratch.keep(sorted_.withColumns({"__part": F.shiftright(place, 33), "__place": place.bitwiseAND((1 << 33) - 1)}), "numbered")
    sizes = {r[0]: r[1] for r in sorted_.groupBy("__part").agg(F.count(F.lit(1))).collect()}
    before, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    begins = docs.sparkSession.createDataFrame(rows, "__part long, __before long")
    return sorted_.join(F.broadcast(begins), "__part").withColumn("row", F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(lengths: np.ndarray, most: int):
    """Cuts rows into runs of at most ``most`` units (one row may be larger)."""
    i, n = 0, len(lengths)
    ends = np.cumsum(lengths)
    while i < n:
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right"))
        yield i, max(j, i + 1)
        i = max(j, i + 1)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def inputs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
