"""Packing documents into sequences, shortest pack first over the histogram of lengths.

A document is cut into whole sequences and a rest of fewer ids. The rests' lengths are counted; the plan takes lengths from
long to short and puts each on the packs that are emptiest (the shortest packs), so that one entry moves many packs of a
pattern at once and only patterns and their counts are held: never a document. Patterns go back to the documents by rank:
the k-th rest of a length belongs to the k-th place that the plan has for the length.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import cut, kept, raw, slices, tidy

# Fixed value: how the byte-level vocabulary cuts text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of a length that one task ranks, about.
RUN = 1 << 16


class Tokens:
    """Ids of texts by a byte-level vocabulary file: tiktoken's over the file's tokens, and the tokenizers library itself for
    the texts that tiktoken's pattern search gives up (very long runs of blanks)."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        self.path, self.special, self._library = path, set(special), None
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def of(self, text: str) -> list[int]:
        try:
            return self.encoding.encode(text, allowed_special=self.special)
        except ValueError:
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path)
                self._library.no_truncation()
                self._library.no_padding()
            return self._library.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's pieces: doc_id, start, length, doc_tokens and ids (little-endian uint32)."""

    def run(batches):
        tokens = Tokens(tokenizer_path)
        for batch in batches:
            _, offsets = raw(batch.column(1))
            for a, b in slices(offsets):
                doc_ids, cols = batch.column(0).slice(a, b - a).to_pylist(), [[], [], [], [], []]
                for doc_id, text in zip(doc_ids, batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    ids = np.array([*tokens.of(text or ""), end_id], "<u4")
                    for at in range(0, len(ids), size):
                        part = ids[at : at + size].tobytes()
                        for col, x in zip(cols, (doc_id, at, len(part) // 4, len(ids), part), strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a pack) and how many packs have each, for histogram's lengths (at most size) and counts."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room == 0:
            done.append((pattern, n))
            return
        if not open_packs[room]:
            insort(rooms, room)
        open_packs[room].append((pattern, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:  # the shortest pack has the most room
                room = rooms[-1]
                pattern, n = open_packs[room].pop()
                if not open_packs[room]:
                    del rooms[bisect_left(rooms, room)]
                m = min(n, left)
                if n > m:
                    put(room, pattern, n - m)
                put(room - length, (*pattern, length), m)
            else:
                m = left
                put(size - length, (length,), m)
            left -= m
    return [*done, *(x for room in rooms for x in open_packs[room])]


def pack(parts: DataFrame, size: int = 1024) -> DataFrame:
    """pieces() with sequence_id and offset; parts is a kept table with a number of each piece, `piece`.

    Lengths meet as a histogram of at most size rows; the plan has at most a few patterns a length and is broadcast. Ranks
    within a length are counted in runs of about RUN pieces, chosen by the piece's number, of which one row each is
    broadcast. Whole sequences need no rank and aren't shuffled: they are numbered after the packed ones, with gaps.
    """
    rests = parts.where(F.col("length") < size)
    histogram = {r["length"]: r["count"] for r in rests.groupBy("length").count().collect()}
    places, packs = defaultdict(list), 0  # by length: first rank, its sequence, offset
    seen: dict[int, int] = defaultdict(int)
    for pattern, n in plan(histogram, size):
        at = 0
        for length in pattern:
            places[length].append((seen[length], packs, at))
            seen[length] += n
            at += length
        packs += n
    table = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in places.items()}
    spark, columns = parts.sparkSession, [c for c in parts.columns if c != "piece"]
    whole = parts.where(F.col("length") == size).select(*columns, (F.lit(packs) + F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    runs = spark.createDataFrame([(k, n // RUN + 1) for k, n in histogram.items()], "length long, runs long")
    salted = rests.join(F.broadcast(runs), "length").withColumn("salt", F.pmod(F.xxhash64("piece"), F.col("runs")))
    counts = cut(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, batch.num_columns - 1))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                first, start, at = table[int(n)]
                k = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = start[k] + rank[own] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    own = Window.partitionBy("length", "salt").orderBy("piece")
    ranked = salted.join(F.broadcast(ranks), ["length", "salt"]).select(*columns, (F.col("first") + F.row_number().over(own) - 1).alias("rank"))
    return ranked.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)).unionByName(whole)


@tidy
def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, sequence_id and offset of every piece.

    A null or empty text has the end id alone. Each row is packed, also rows that repeat an id or have none; their pieces
    then share doc_id and start. A text longer than a sequence is cut; an empty table gives no rows; other columns aren't read.
    """
    parts = pieces(docs, tokenizer_path, size, end_id).withColumn("piece", F.monotonically_increasing_id())
    return pack(kept(parts, "zstd"), size)
