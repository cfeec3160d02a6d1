"""Approximate nearest neighbours: inverted lists, scanned dimension by dimension with early abandonment.

Vectors are rotated by a random orthogonal matrix, so that the first d of D coordinates estimate a distance. k-means over a
bounded sample of distinct vectors gives the lists; every vector goes to its nearest one. Lists are dealt as cells of bounded
size. A query probes its nearest lists, as many as brute force within the sample asks for, and further ones until these hold
several times k vectors. Its nearest list is scanned first; the k-th distance found there is the bound that it carries to the
others, and that tightens while a cell is scanned. In each cell the candidates' coordinate blocks are added one block at a
time, and a candidate is abandoned when the hypothesis that it is among the nearest is rejected, that is when its partial
distance exceeds the bound by the factor 1 + e / sqrt(d). Survivors are measured in double precision on the original vectors.

Equal vectors are one class. As ties go to the smaller id, only the k + 1 rows of a class with the smallest ids can be among
the k nearest of anything, so only these are indexed, and a class is searched once for all its queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, kept, lookup, shuffle_width, tidy

#: Vectors that the lists' centres are fitted on: 16 a list, at most so many; the first by a hash of the id.
SAMPLE = 1 << 17
#: Vectors, and queries, of a cell, about.
CELL, ASKED = 4096, 4096
#: Candidates between two looks at the bound.
STEP = 512
BLOCK = 16
CERTAINTY = 2.1


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, row (a number of the row), v (binary doubles), dim of the rows that take part: no nulls, all components finite,
    not all zero."""

    def run(batches):
        for batch in batches:
            at = np.concatenate([[0], np.cumsum(batch.column(3).to_numpy().astype(np.int64))]) * 8
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("<f8")
            body = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), body.cast(pa.binary()), batch.column(3)], ["vec_id", "row", "v", "dim"])

    e = F.col("e")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), vectors[vector_col].cast("array<double>").alias("e"))
    taking = rows.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(whole & F.exists(e, lambda x: x != 0))
    return taking.select("vec_id", "row", "e", F.size("e").alias("dim")).mapInArrow(run, "vec_id long, row long, v binary, dim int")


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(5).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def centres(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means (Lloyd) from k of the points; empty lists go, and equal centres are one, so that rounding can't part equal vectors."""
    c = points[np.random.default_rng(3).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = nearest(points, c, 1)[:, 0]
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, points)
        c = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
    return np.unique(c, axis=0)


def nearest(points: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each point, nearest first."""
    out = []
    for k in range(0, len(points), 1024):
        d = (c * c).sum(1) - 2 * points[k : k + 1024] @ c.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :n] if n > 1 else d.argmin(1)[:, None])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def probes_for(points: np.ndarray, c: np.ndarray, k: int, aim: float, queries: int = 256) -> int:
    """How many lists hold the share aim of the k nearest, by brute force within the sample of distinct points."""
    asked = points[np.random.default_rng(4).permutation(len(points))[:queries]]
    own = nearest(points, c, 1)[:, 0]
    order = nearest(asked, c, len(c))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(c))[None, :].repeat(len(asked), 0), 1)
    found = []
    norms = (points * points).sum(1)
    for j, q in enumerate(asked):
        d = norms - 2 * points @ q
        near = np.argpartition(d, min(k + 1, len(d) - 1))[: k + 1]  # the point itself is in its nearest list
        found.append(rank[j, own[near]])
    return min(len(c), int(np.quantile(np.concatenate(found), aim)) + 1)


def scan_cell(ids: np.ndarray, rows: np.ndarray, original: np.ndarray, blocks: list[np.ndarray], norms: np.ndarray, query: np.ndarray, turned: np.ndarray, k: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of a cell for a query that are not beyond bound: positions and distances, ties to the smaller id, row."""
    dim = len(turned)
    found, distance = np.zeros(0, np.int64), np.zeros(0)
    rounding = 1e-5 * float(turned @ turned)  # of the rotated floats
    for first in range(0, len(ids), STEP):
        live = np.arange(first, min(first + STEP, len(ids)))
        if np.isfinite(bound):
            slack = rounding + 1e-5 * norms[live]
            partial, at = np.zeros(len(live), np.float32), 0
            for b in blocks:
                d = at + b.shape[1]
                partial = partial + ((b[live] - turned[at:d]) ** 2).sum(1)
                factor = 1.0 if d == dim else (1 + CERTAINTY / np.sqrt(d)) ** 2
                stay = partial * (dim / d) <= bound * bound * factor + slack
                live, partial, slack = live[stay], partial[stay], slack[stay]
                at = d
                if not len(live):
                    break
        if not len(live):
            continue
        found, distance = np.concatenate([found, live]), np.concatenate([distance, np.sqrt(((original[live] - query) ** 2).sum(1))])
        best = np.lexsort((rows[found], ids[found], distance))[:k]
        found, distance = found[best], distance[best]
        if len(found) == k:
            bound = min(bound, float(distance[-1]))
    return found, distance


@tidy
def search(vectors: DataFrame, query_every: int = 100, k: int = 10, aim: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query (ids divisible by query_every) among the other vectors.

    Vectors that are null, zero, or hold null or non-finite components take no part; nor do rows without an id, and those
    of another dimension than most have (of equally frequent dimensions the smallest counts). Rows count one by one: one that
    repeats an id is a vector of its own, also for the queries of that id. Every query has k rows, or all others if there are
    fewer; an empty table gives no rows; no other columns are read.
    """
    spark = vectors.sparkSession
    rows = kept(valid(vectors, id_col, vector_col))
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims["dim"]
    rows = rows.where(F.col("dim") == dim).withColumn("h", F.xxhash64("v"))
    equal = Window.partitionBy("h", "v").orderBy("vec_id", "row")
    base = rows.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1)
    base = kept(base.select("vec_id", "row", "v", "h", "copy"))
    classes = base.where("copy = 1").select("h", "v", F.col("row").alias("class"))
    members = kept(lookup(rows.where(F.pmod("vec_id", F.lit(query_every)) == 0).select("vec_id", "row", "h", "v"), classes, ["h", "v"]).select("vec_id", "row", "class"))
    n = base.count()
    lists = max(1, min(1 << 14, int(n**0.5), SAMPLE // 16))
    few = classes.orderBy("h", "class").limit(16 * lists).select("v").toArrow().column(0).to_pylist()
    turn = rotation(dim)
    points = (np.frombuffer(b"".join(few)).reshape(-1, dim) @ turn).astype(np.float32)
    c = centres(points, max(1, min(lists, len(points) // 16)))
    probes = probes_for(points, c, k, aim)
    sent = spark.sparkContext.broadcast((turn, c))

    def assign(batches):
        turn, c = sent.value
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, dim)
            own = nearest((v @ turn).astype(np.float32), c, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], ["vec_id", "row", "v", "list"])

    assigned = kept(base.select("vec_id", "row", "v").mapInArrow(assign, "vec_id long, row long, v binary, list int"))
    sizes = np.zeros(len(c), np.int64)  # one count a list
    for r in assigned.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    held = spark.sparkContext.broadcast(sizes)

    def probe(batches):
        (turn, c), sizes = sent.value, held.value
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, dim)
            out = []
            for a in range(0, len(v), 1024):
                order = nearest((v[a : a + 1024] @ turn).astype(np.float32), c, len(c)) if len(c) > 1 else np.zeros((len(v[a : a + 1024]), 1), np.int64)
                before = np.cumsum(sizes[order], 1) - sizes[order]
                wanted = ((np.arange(len(c)) < probes) | (before < 4 * (k + 1))) & (sizes[order] > 0)
                q, place = np.nonzero(wanted)
                nearer = np.cumsum(wanted, 1)[q, place]
                out.append((q + a, order[q, place], nearer > 1))
            at, own, later = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 3))
            take = pa.array(at.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(own.astype(np.int32)), pa.array(later.astype(bool))], ["class", "v", "list", "later"])

    asked = members.select("class").distinct().join(classes, "class").select("class", "v")
    routes = kept(asked.mapInArrow(probe, "class long, v binary, list int, later boolean"))

    def scan(queries: DataFrame) -> DataFrame:
        """class, vec_id, row, score: the nearest of each cell of the queries' lists, queries in groups of about ASKED."""
        groups = queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("groups"))
        cells = spark.createDataFrame([(int(j), -(-int(x) // CELL)) for j, x in enumerate(sizes) if x], "list int, cells long").join(groups, "list")
        cells = F.broadcast(cells)  # a row a list
        per_cell = F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)
        per_group = F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)
        here = assigned.join(cells, "list").select("list", F.pmod(F.xxhash64("row"), "cells").alias("part"), F.explode(per_group).alias("group"), F.lit(0).alias("kind"), "vec_id", "row", "v", F.lit(None).cast("double").alias("bound"))
        there = queries.join(cells, "list").select("list", F.explode(per_cell).alias("part"), F.pmod(F.xxhash64("class"), "groups").alias("group"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.col("class").alias("row"), "v", "bound")

        def run(batches):
            turn, _ = sent.value
            cell, held, ready = None, [], None
            for batch in batches:
                out: list[list] = [[], [], [], []]
                for a, b, g, kind, i, row, v, bound in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if (a, b, g) != cell:
                        cell, held, ready = (a, b, g), [], None
                    if kind == 0:
                        held.append((i, row, v))
                        continue
                    if not held:
                        continue
                    if ready is None:
                        ids, own, original = np.array([x[0] for x in held]), np.array([x[1] for x in held]), np.frombuffer(b"".join([x[2] for x in held])).reshape(-1, dim)
                        turned = (original @ turn).astype(np.float32)
                        ready = ids, own, original, [np.ascontiguousarray(turned[:, x : x + BLOCK]) for x in range(0, dim, BLOCK)], (turned * turned).sum(1)
                    q = np.frombuffer(v)
                    near, score = scan_cell(*ready, q, (q @ turn).astype(np.float32), k + 1, np.inf if bound is None else bound)
                    for col, x in zip(out, ([row] * len(near), ready[0][near].tolist(), ready[1][near].tolist(), score.tolist()), strict=True):
                        col.extend(x)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.float64())], ["class", "vec_id", "row", "score"])

        place = ["list", "part", "group"]
        met = here.unionByName(there).repartition(2 * shuffle_width(spark), *place).sortWithinPartitions(*place, "kind", "vec_id", "row")
        found = met.select(*place, "kind", "vec_id", "row", "v", "bound").mapInArrow(run, "class long, vec_id long, row long, score double")
        best = F.row_number().over(Window.partitionBy("class").orderBy("score", "vec_id", "row"))
        return kept(found.withColumn("rank", best).where(F.col("rank") <= k + 1).drop("rank"))

    nearby = scan(routes.where("not later").withColumn("bound", F.lit(None).cast("double")))
    bounds = nearby.groupBy("class").agg(F.when(F.count(F.lit(1)) > k, F.max("score")).alias("bound"))
    farther = scan(routes.where("later").join(bounds, "class", "left"))
    best = F.row_number().over(Window.partitionBy("class").orderBy("score", "vec_id", "row"))
    both = nearby.unionByName(farther).withColumn("rank", best).where(F.col("rank") <= k + 1)
    answers = cut(both.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id", "row"))).alias("near")))  # k + 1 at most
    own = lookup(members, answers, ["class"]).select("vec_id", F.slice(F.filter("near", lambda x: x["row"] != F.col("row")), 1, k).alias("near"))
    return own.select(F.col("vec_id").alias("query_id"), F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
