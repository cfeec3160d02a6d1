"""Token ids in files of Simple-8b blocks.

A file is a Parquet part whose rows are blocks; a block holds consecutive documents of one shard, shards and blocks in
ascending order of doc_id. Of a block: start (the shard's ids before it), doc_ids, lengths (uint32 a document), words (uint64,
each a 4-bit selector above 60 bits that hold as many ids as the selector says), lanes (uint32: the first word of every run of
LANE ids, where a reader can start), escapes (uint64 ids of over 60 bits, named by number in a word of their own) and n_ids.
Both directions are vectorised: encoding steps through all lanes together, decoding handles all words of a selector at once,
and reads a block from lane to lane, so that no more than a run of documents is held decoded.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import build_lexicon, encode_with
from .common import shared_dir, shuffle_width, span_hashes, tidy

# Ids in a word and bits of each, by selector; the last selector marks an escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
ESCAPE = 14
LANE = 256
#: Ids of a block, and of what is decoded at once, about; a document with more is a block of its own.
BLOCK = 1 << 19
#: Quantiles of the ids that are asked for, at most.
QUANTILES = 4096
_CLASS = np.array([int(np.searchsorted(BITS[:ESCAPE], max(1, x.bit_length()))) for x in range(1 << 16)], np.int8)
SCHEMA = "shard int, start long, n_ids long, doc_ids array<long>, lengths binary, words binary, lanes binary, escapes binary"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, each lane's first word, and escapes of unsigned 64-bit ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    lanes = -(-n // LANE)
    ends = np.minimum(np.arange(1, lanes + 1) * LANE, n)
    if int(ids.max()) < len(_CLASS):
        kind = _CLASS[ids]
    else:
        kind = np.zeros(n, np.int8)
        for b in BITS[:ESCAPE]:
            kind += ids >> np.uint64(b) != 0
    room = np.minimum(np.repeat(ends, LANE)[:n] - np.arange(n), 100).astype(np.int8)
    # the largest kind among the next c ids, for each c, from two shorter stretches that make c together
    most, selector = {1: kind}, np.full(n, ESCAPE, np.int8)
    for s in range(ESCAPE - 1, -1, -1):
        c = int(COUNTS[s])
        if c not in most:
            x, y = next((x, c - x) for x in sorted(most, reverse=True) if c - x in most)
            most[c] = most[x].copy()
            np.maximum(most[x][: n - x], most[y][x:], out=most[c][: n - x]) if n > x else None
        np.putmask(selector, (most[c] <= s) & (room >= c), s)  # from few ids to many: the last that fits stays
    at, live, used = np.arange(lanes) * LANE, np.arange(lanes), []
    while len(live):
        now = at[live]
        used.append(now)
        now = now + COUNTS[selector[now]]
        at[live] = now
        live = live[now < ends[live]]
    place = np.sort(np.concatenate(used))
    own = selector[place]
    word = own.astype(np.uint64) << np.uint64(60)
    large = ids >> np.uint64(60) != 0
    for s in np.unique(own):
        k = np.flatnonzero(own == s)
        first = place[k]
        if s == ESCAPE:
            word[k] |= (np.cumsum(large) - 1)[first].astype(np.uint64)
            continue
        body = ids[first]
        for j in range(1, COUNTS[s]):
            body |= ids[first + j] << np.uint64(j * BITS[s])
        word[k] |= body
    return word, np.searchsorted(place, np.arange(lanes) * LANE).astype(np.uint32), ids[large]


def unpack(words: np.ndarray, lanes: np.ndarray, escapes: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Of pack()'s n ids those from first to last, read from the lanes that hold them."""
    last = n if last is None else last
    if first >= last:
        return np.zeros(0, np.uint64)
    lane, end = first // LANE, -(-last // LANE)
    words = words[lanes[lane] : lanes[end] if end < len(lanes) else len(words)]
    skip, out = lane * LANE, np.zeros(min(end * LANE, n) - lane * LANE, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    at = np.cumsum(counts) - counts
    body = words & np.uint64((1 << 60) - 1)
    for s in np.unique(selector):
        k = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[at[k]] = escapes[body[k].astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(COUNTS[s]):
            out[at[k] + j] = body[k] >> np.uint64(j * BITS[s]) & mask
    return out[first - skip : last - skip]


def _bounds(keys: DataFrame, shards: int) -> tuple[np.ndarray, int]:
    """Lower ends of the shards but the first, by approximate quantiles of k, and how many shards come before them for rows
    without an id. A frequent id is the lower end of several."""
    none, total = keys.agg(F.sum(F.col("k").isNull().cast("long")), F.count(F.lit(1))).first()
    before = -(-shards * (none or 0) // max(total, 1))
    rest = max(shards - before, 1)
    points = min(rest, QUANTILES)
    found = keys.agg(F.percentile_approx("k", [j / points for j in range(1, points)], 10000)).first()[0] if points > 1 else []
    bounds = np.array(sorted(found or []), np.int64)
    if rest > points and len(bounds) > 1:  # between quantiles by the ids' values
        bounds = np.interp(np.linspace(0, len(bounds) - 1, rest - 1), np.arange(len(bounds)), bounds).astype(np.int64)
    return bounds, before


def _shard(keys: pa.Array, salt: np.ndarray, bounds: np.ndarray, before: int) -> np.ndarray:
    """Each row's shard: that of its id; rows without an id, and of an id that several shards have, are dealt by salt."""
    k = keys.fill_null(0).to_numpy(zero_copy_only=False)
    low, high = (before + np.searchsorted(bounds, k, side) for side in ("left", "right"))
    low = np.minimum(low + 1, high)  # the shard before the first equal bound ends below it
    none = keys.is_null().to_numpy(zero_copy_only=False)
    low, high = np.where(none, 0, low), np.where(none, max(before - 1, 0), high)
    return low + salt % (high - low + 1)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, shards: int, id_col: str, text_col: str) -> DataFrame:
    """shard, k, ids (little-endian uint16 where the vocabulary fits, else uint32; the end id last) of every row."""
    lexicon = build_lexicon(docs, tokenizer_path, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].cast("string").alias("text"))
    bounds, before = _bounds(rows.select(F.col("key").alias("k")), shards)

    def emit(encoder, keys, e):
        kind = _kind(max(len(encoder.vocabulary.tokens) - 1, end_id))
        stream = np.insert(e.ids, e.offsets[1:], end_id).astype(kind)
        at = (e.offsets + np.arange(len(e.offsets))) * stream.itemsize
        body = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(stream.tobytes())])
        salt = span_hashes(stream.view(np.uint8), at[:-1], at[1:]).astype(np.int64) & 0x7FFFFFFF
        return pa.RecordBatch.from_arrays([pa.array(_shard(keys, salt, bounds, before).astype(np.int32)), keys, body.cast(pa.binary())], ["shard", "k", "ids"])

    return encode_with(rows, lexicon, tokenizer_path, emit, "shard int, k long, ids binary")


def _kind(top: int) -> str:
    return "<u2" if top < 1 << 16 else "<u4"


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encodes every whole text, appends end_id to each document and writes the files in ascending order of doc_id.

    A null text counts as empty and has the end id alone. Rows without an id come first; rows that repeat an id stay, side
    by side. An empty table writes no block. Shards are ranges of doc_id, by quantiles; what is dealt and sorted are the ids,
    not the texts, and even the rows of one id or of none are dealt to several shards where they are many. A block has about
    BLOCK ids, or one document.
    """
    from .bpe import tables

    kind = _kind(max(len(tables(tokenizer_path)[0].tokens) - 1, end_id))
    shards = shards or 2 * shuffle_width(docs.sparkSession)
    dealt = encoded(docs, tokenizer_path, end_id, shards, id_col, text_col).repartition(shards, "shard").sortWithinPartitions("shard", "k")

    def run(batches):
        start, held, size = 0, [], 0

        def block():
            nonlocal start
            stream = np.frombuffer(b"".join([x for _, _, x in held]), kind)
            lengths = np.array([len(x) for _, _, x in held], np.int64) // stream.itemsize
            words, lanes, escapes = pack(stream)
            own = [[held[0][0]], [start], [len(stream)], [[k for _, k, _ in held]], [lengths.astype("<u4").tobytes()], [words.astype("<u8").tobytes()], [lanes.astype("<u4").tobytes()], [escapes.astype("<u8").tobytes()]]
            start += len(stream)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(own, types, strict=True)], NAMES)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != held[0][0] or size + len(row[2]) > BLOCK * np.dtype(kind).itemsize):
                    yield block()
                    start = start if row[0] == held[0][0] else 0
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield block()

    dealt.mapInArrow(run, SCHEMA).write.option("compression", "snappy").parquet(path)


def read(spark: SparkSession, path: str, payload: str = "ids") -> DataFrame:
    """Each document of the files: doc_id, start (ids of all documents before it), n_tokens, and ids (array<long>) or, for
    payload "crc32", ids_crc32 of them as little-endian unsigned 32-bit integers. Only the shards' totals, one row a shard,
    are broadcast."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    name, kind = ("ids_crc32", pa.int64()) if payload == "crc32" else ("ids", pa.list_(pa.int64()))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                start, doc_ids, lengths, words, lanes, escapes, n = (c[k].as_py() for c in batch.columns)
                sizes = np.frombuffer(lengths, "<u4").astype(np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                words, lanes, escapes = np.frombuffer(words, "<u8"), np.frombuffer(lanes, "<u4"), np.frombuffer(escapes, "<u8")
                a = 0
                while a < len(sizes):
                    b = max(a + 1, int(np.searchsorted(at, at[a] + BLOCK // 4, "right")) - 1)
                    ids = unpack(words, lanes, escapes, n, int(at[a]), int(at[b]))
                    parts = [ids[x - at[a] : y - at[a]] for x, y in zip(at[a:b], at[a + 1 : b + 1], strict=True)]
                    values = [zlib.crc32(x.astype("<u4").tobytes()) if payload == "crc32" else x.astype(np.int64) for x in parts]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64()), pa.array(start + at[a:b]), pa.array(sizes[a:b]), pa.array(values, kind)], ["doc_id", "start", "n_tokens", name])
                    a = b

    placed = blocks.join(F.broadcast(starts), "shard").select((F.col("shard_start") + F.col("start")).alias("start"), "doc_ids", "lengths", "words", "lanes", "escapes", "n_ids")
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} " + ("long" if payload == "crc32" else "array<long>"))


@tidy
def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, payload: str = "crc32") -> DataFrame:
    """Writes the documents to files in the shared folder and reads these."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, tokenizer_path, path, end_id)
    return read(docs.sparkSession, path, payload)
