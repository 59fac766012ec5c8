"""What the text operators share: column picking, durable intermediate tables, stable word hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 64-bit odd constants of the polynomial over word hashes (fixed values).
MULTIPLIER = 0x9E3779B97F4A7C15
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def pick(df: DataFrame, *names: str, keep_rest: bool = False) -> DataFrame:
    """The named columns, found by exact name first, whatever other columns there are.

    Other columns may clash in case, repeat a name or hold dots; they are renamed by place first, so none is ambiguous.
    With keep_rest the others follow as _rest0, _rest1 and so on.
    """
    have = df.columns
    spots = []
    for name in names:
        exact = [i for i, c in enumerate(have) if c == name] or [i for i, c in enumerate(have) if c.lower() == name.lower()]
        if not exact:
            raise ValueError(f"no column {name}")
        spots.append(exact[0])
    flat = df.toDF(*[f"_c{i}" for i in range(len(have))])
    cols = [F.col(f"_c{i}").alias(n) for i, n in zip(spots, names, strict=True)]
    if keep_rest:
        cols += [F.col(f"_c{i}").alias(f"_rest{k}") for k, i in enumerate(i for i in range(len(have)) if i not in spots)]
    return flat.select(*cols)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id as long and text without nulls (null: empty)."""
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Without one there is no safe place: an error, for a local
    folder would lose rows on a cluster."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path and sc.master.startswith("local["):  # one machine: any folder is shared
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path


#: Spark removes a query's shuffle files when the query ends, if this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, so a lost executor repeats no earlier stage.

    The shuffle files behind it are removed with the write's end, for nothing reads them again (a plan that does makes them anew);
    the session's setting for that is put back as it was."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark).rstrip('/')}/placeloom/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables made by stored, which no plan that is still to run may read."""
    for df in tables:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/placeloom/" in folder:
                at = hadoop(folder)
                at.getFileSystem(conf).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def tidy(run):
    """run (a function of Arrow batches), which at its end gives the memory that it no longer needs back to the system: a Python worker
    lives on, and else holds its largest size beside all later stages."""

    def tidied(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim:
            trim(0)

    return tidied


def slices(batches, column: str = "text", most: int = 2_000_000):
    """The batches cut into runs of rows with about `most` bytes in `column`, so that a run of very long texts fits a Python worker.
    (Spark itself holds a batch under spark.sql.execution.arrow.maxBytesPerBatch.)"""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        c = batch.column(column)
        size = np.cumsum(pc.fill_null(pc.binary_length(c if not pa.types.is_string_view(c.type) else c.cast(pa.string())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


class Numbers(dict):
    """Whole numbers of words from a function, remembered; it starts anew when it has grown to `most` words."""

    def __init__(self, f, most: int = 400_000, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.f, self.most, self.fixed = f, most, fixed or {}

    def __missing__(self, word):
        self[word] = n = self.f(word)
        return n

    def of(self, words: list[bytes], dtype=None):
        """The numbers of words as a numpy array (int64 unless said otherwise)."""
        import numpy as np

        if len(self) > self.most:
            self.clear()
            self.update(self.fixed)
        return np.fromiter(map(self.__getitem__, words), dtype or np.int64, len(words))


def word_ids() -> Numbers:
    """Stable 64-bit numbers of words (bytes)."""
    import xxhash

    return Numbers(xxhash.xxh64_intdigest)


def mixed(x):
    """A bijection of 64-bit numbers whose output bits depend on all input bits (numpy uint64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids, n: int = 5):
    """Distinct 64-bit hashes, ascending, of the n-word shingles; fewer words make one shingle of all; none without words."""
    import numpy as np

    if not len(ids):
        return np.zeros(0, np.uint64)
    n = min(n, len(ids))
    h = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(MULTIPLIER) + ids[k : len(ids) - n + 1 + k]
    return np.unique(mixed(h))


def texts_of(batch, column: str = "text"):
    """The texts of an Arrow batch as bytes, without making Python strings; null: empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in batch.column(column).cast(pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()).to_pylist()]
