"""What the operators share: reading, cutting lineage, and splitting whole texts into hashed words with numpy."""

from __future__ import annotations

import functools
import hashlib
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are held as arrays at once; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first k bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans up to here are hashed eight bytes at a time, all together; longer ones one by one.
_STEPPED = 1 << 10


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as little-endian integers; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span of bytes. Spans of up to 7 bytes have a key of their own; longer ones are hashed."""
    size, wide = ends - starts, _windows(data)
    key = wide[starts] & _FIRST[np.minimum(size, 8)]
    short = size <= 7
    long = np.flatnonzero(~short)
    h = mix64(key[long] + size[long].astype(np.uint64) * _GOLDEN)
    live, at = np.flatnonzero((size[long] > 8) & (size[long] <= _STEPPED)), 8
    while len(live):
        own = long[live]
        part = wide[starts[own] + at] & _FIRST[np.minimum(size[own] - at, 8)]
        h[live] = mix64((h[live] ^ part) + _GOLDEN)
        at += 8
        live = live[size[own] > at]
    for k in np.flatnonzero(size[long] > _STEPPED):
        own = long[k]
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[own] : ends[own]].tobytes(), digest_size=8).digest(), "little")
    key[short] |= size[short].astype(np.uint64) << np.uint64(56)
    key[long] = h | np.uint64(1 << 63)
    return mix64(key)


def forms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each span's form, numbered, and the first span of each form: spans are of one form when key and bytes are equal."""
    form, unique = pd.factorize(keys)
    first = np.zeros(len(unique), np.int64)
    first[form[::-1]] = np.arange(len(form))[::-1]
    size, wide = ends - starts, _windows(data)
    again = np.flatnonzero(size > 7)
    again = again[first[form[again]] != again]
    one = first[form[again]]
    equal, at, live = size[again] == size[one], 0, np.arange(len(again))
    live = live[equal & (size[again] <= _STEPPED)]
    while len(live):
        a, b = again[live], one[live]
        same = ((wide[starts[a] + at] ^ wide[starts[b] + at]) & _FIRST[np.minimum(size[a] - at, 8)]) == 0
        equal[live] &= same
        at += 8
        live = live[same & (size[a] > at)]
    for k in np.flatnonzero(equal & (size[again] > _STEPPED)):
        equal[k] = (data[starts[again[k]] : ends[again[k]]] == data[starts[one[k]] : ends[one[k]]]).all()
    if not equal.all():  # a hash of two texts: the bytes themselves tell them apart
        body, names = data.tobytes(), {}
        form = np.array([names.setdefault((k, body[a:b]), len(names)) for k, a, b in zip(keys.tolist(), starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.zeros(len(names), np.int64)
        first[form[::-1]] = np.arange(len(form))[::-1]
    return form, first


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's offsets in them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of rows with at most limit bytes together, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes that are not white space, lower-cased A-Z: each word's row and 64-bit hash."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (edge[:-1] | ~before))
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (edge[1:] | ~after)) + 1
    return np.searchsorted(offsets, starts, "right") - 1, span_hashes(data, starts, ends)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session without one is given a temporary folder if it is local, and else refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="askframe-"))
    return sc.getCheckpointDir()


@contextmanager
def _shuffles_go(spark: SparkSession):
    """What runs inside leaves no shuffle files behind: its result is kept elsewhere, so nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, with no lineage before them."""
    shared_dir(df.sparkSession)
    with _shuffles_go(df.sparkSession):
        return df.checkpoint(eager=True)


def kept(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Like cut(), as a compressed Parquet table of the shared folder, for what is large."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _shuffles_go(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what kept() has written, once nothing reads it any more; tables of other origin stay."""
    for table in tables:
        if path := getattr(table, "kept_at", None):
            sc = table.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def tidy(operator):
    """An operator all of whose eager steps leave no shuffle files behind."""

    @functools.wraps(operator)
    def run(first: DataFrame, *args, **settings):
        with _shuffles_go(first.sparkSession):
            return operator(first, *args, **settings)

    return run


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores before it until no column is called so in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


#: Files whose rows are numbered by file and place; of more files a numbered copy is kept.
FILES = 1 << 16


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of each row that stays the same in every later reading, and that column's name.

    Where docs is read from Parquet files, with no more than columns and rows left out, that is the file's number and the
    row's place in it; else a numbered copy is kept."""
    row = free_name(docs.columns, "_row")
    if _scans(docs):
        try:
            placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
            files = sorted(r[0] for r in placed.select("_file").distinct().limit(FILES + 1).collect())
        except AnalysisException:
            files = []
        if 0 < len(files) <= FILES:
            numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "_file string, _number long")
            number = (F.shiftleft(F.col("_number"), 40) + F.col("_place")).alias(row)
            return placed.join(F.broadcast(numbers), "_file").select(*docs.columns, number), row
    return kept(docs.withColumn(row, F.monotonically_increasing_id()), "zstd"), row


def _scans(docs: DataFrame) -> bool:
    """Whether docs is a table's rows as they are stored, or some of them by fixed conditions."""
    if {"_metadata", "_file", "_place", "_number"} & {c.lower() for c in docs.columns} or len(set(docs.columns)) < len(docs.columns):
        return False
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "Relation")


#: Row numbers that are broadcast, at most; more are joined by a shuffle of the rows.
SENT = 1 << 21


def few(numbers: DataFrame) -> DataFrame:
    """A table of row numbers alone, marked for a broadcast if it has no more than SENT rows."""
    numbers = cut(numbers)
    return F.broadcast(numbers) if numbers.count() <= SENT else numbers


#: A key is hot when it has more than one row of so many; at most as many keys are.
HOT = 2048


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which has a key once. The rows of left's hot keys, at most HOT keys, meet right's in a
    broadcast of at most that many rows, so that no task gets all rows of a key; left should be a kept table."""
    total = left.count()
    hot = cut(left.groupBy(*on).count().where(F.col("count") * HOT > F.lit(total)).select(*on))
    if total < HOT * 16 or not hot.take(1):
        return left.join(right, on, how)
    few = cut(right.join(F.broadcast(hot), on, "left_semi"))
    of_hot = left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how)
    return of_hot.unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right, on, how))


def most_frequent(counts: DataFrame, n: str, tie: Column, limit: int) -> DataFrame:
    """The limit rows of counts with the highest n, ties by the smallest tie: exactly so many, or all.

    Counts beyond 4096 are compared by their twelve highest bits, so that at most some 100,000 levels reach the driver.
    """
    shift = f"greatest(0, length(bin(`{n}`)) - 12)"
    marked = counts.withColumns({"_level": F.expr(f"shiftleft(shiftright(`{n}`, {shift}), {shift})"), "_tie": tie, "_bin": F.pmod(tie, F.lit(4096))})

    def border(levels: pd.DataFrame, room: int) -> tuple[int | None, int]:
        """The first level that doesn't fit whole, and the room that is left for it."""
        sums = levels["count"].cumsum()
        over = levels[sums > room]
        if not len(over):
            return None, 0
        return int(over["k"].iloc[0]), room - int(sums[sums <= room].max() if (sums <= room).any() else 0)

    level, room = border(marked.groupBy(F.col("_level").alias("k")).count().toPandas().sort_values("k", ascending=False, ignore_index=True), limit)
    if level is None:
        return counts
    tied = marked.where(F.col("_level") == level)
    bin_, left = border(tied.groupBy(F.col("_bin").alias("k")).count().toPandas().sort_values("k", ignore_index=True), room)
    whole = marked.where((F.col("_level") > level) | ((F.col("_level") == level) & (F.col("_bin") < bin_)))
    rest = tied.where(F.col("_bin") == bin_).orderBy("_tie").limit(left)
    return whole.unionByName(rest).select(*counts.columns)


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def crc_bucket(column: Column, n: int) -> Column:
    """crc32 of a number's decimal text, modulo n."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
