"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy on the driver by backpropagation through time, on windows of a bounded sample of labelled
texts. It labels every byte position of every text, window by window; a document's probabilities are the mean of those of
its letters' positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, free_name, raw, slices, tidy

UNDETERMINED = "und"
_VOTES = np.zeros(256, bool)
_VOTES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Settings:
    """hidden units of each direction, bytes of a window, sampled texts of a language (fewer where there are many languages,
    so that about so many texts are sampled in all, but 8 at least), windows of a text, training steps."""

    hidden: int = 8
    window: int = 64
    texts: int = 300
    sampled: int = 38400
    windows: int = 4
    steps: int = 260
    batch: int = 128
    rate: float = 0.02


class Network:
    """Weights: x (direction, 3H, 256) of each byte, u (direction, 3H, H), c (direction, H, 1) of the reset gate's input,
    v (K, 2H) and b (K, 1) of the labels. The rows of x and u are for the update gate, the reset gate and the new state."""

    def __init__(self, languages: list[str], hidden: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        self.w = {
            "x": r.normal(0, 0.3, (2, 3 * hidden, 256)),
            "u": r.normal(0, hidden**-0.5, (2, 3 * hidden, hidden)),
            "c": np.zeros((2, hidden, 1)),
            "v": r.normal(0, 0.3, (len(languages), 2 * hidden)),
            "b": np.zeros((len(languages), 1)),
        }
        self.w = {k: x.astype(np.float32) for k, x in self.w.items()}

    def states(self, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (2, T, H, B) of windows (T, B); the second direction reads backwards, states stand at their bytes."""
        steps, n, h = *data.shape, self.h
        x, u, c = (self.w[k] for k in "xuc")
        out, trace = np.empty((2, steps, h, n), np.float32), []
        s = np.zeros((2, h, n), np.float32)
        for t in range(steps):
            a = np.stack([x[0].take(data[t], 1), x[1].take(data[steps - 1 - t], 1)])
            g = u @ s
            gate = a[:, : 2 * h] + g[:, : 2 * h]
            gate *= 0.5
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            z, r = gate[:, :h], gate[:, h:]
            inner = g[:, 2 * h :] + c
            new = np.tanh(a[:, 2 * h :] + r * inner)
            after = new + z * (s - new)
            if keep:
                trace.append((s, z, r, inner, new))
            s = after
            out[0, t], out[1, steps - 1 - t] = s
        return out, trace

    def labels(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (K, T, B) at each position of windows (T, B)."""
        s, _ = self.states(data)
        both = s.transpose(0, 2, 1, 3).reshape(2 * self.h, -1)
        p = self.w["v"] @ both + self.w["b"]
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        return p.reshape(-1, *data.shape)

    def gradients(self, data: np.ndarray, label: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over valid positions of windows (T, B) with one label each."""
        h, (steps, n) = self.h, data.shape
        s, trace = self.states(data, keep=True)
        both = s.transpose(0, 2, 1, 3).reshape(2 * h, -1)
        p = self.w["v"] @ both + self.w["b"]
        p = np.exp(p - p.max(0))
        p /= p.sum(0)
        p = p.reshape(-1, steps, n)
        p[label, :, np.arange(n)] -= 1
        p = (p * (valid / max(1, valid.sum()))).reshape(len(p), -1).astype(np.float32)
        g = {k: np.zeros_like(w) for k, w in self.w.items()}
        g["v"], g["b"] = p @ both.T, p.sum(1, keepdims=True)
        back = (self.w["v"].T @ p).reshape(2, h, steps, n)
        u = self.w["u"]
        carry = np.zeros((2, h, n), np.float32)
        per_byte = np.zeros((2, 3 * h, 256), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, inner, new = trace[t]
            carry = carry + np.stack([back[0, :, t], back[1, :, steps - 1 - t]])
            d_new = carry * (1 - z) * (1 - new * new)
            d_z = carry * (before - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_inner = d_new * r
            d_x = np.concatenate([d_z, d_r, d_new], 1)
            d_u = np.concatenate([d_z, d_r, d_inner], 1)
            g["u"] += d_u @ before.transpose(0, 2, 1)
            g["c"] += d_inner.sum(2, keepdims=True)
            for k, at in ((0, t), (1, steps - 1 - t)):
                hot = np.zeros((n, 256), np.float32)
                hot[np.arange(n), data[at]] = 1
                per_byte[k] += d_x[k] @ hot
            carry = carry * z + u.transpose(0, 2, 1) @ d_u
        g["x"] = per_byte
        return g


def train(windows: list[bytes], labels: list[str], settings: Settings) -> Network:
    """A network for labelled windows, by Adam; the same for the same windows."""
    names = sorted(set(labels))
    net = Network(names, settings.hidden)
    of = np.array([names.index(x) for x in labels], np.int64)
    data = np.full((settings.window, len(windows)), 32, np.uint8)
    valid = np.zeros((settings.window, len(windows)), bool)
    for k, w in enumerate(windows):
        own = np.frombuffer(w[: settings.window], np.uint8)
        data[: len(own), k], valid[: len(own), k] = own, _VOTES[own]
    r = np.random.default_rng(11)
    by = [np.flatnonzero(of == k) for k in range(len(names))]
    first, second = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    for step in range(1, settings.steps + 1 if len(names) > 1 else 1):
        pick = np.concatenate([r.choice(x, max(1, settings.batch // len(names))) for x in by])
        g = net.gradients(data[:, pick], of[pick], valid[:, pick])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = settings.rate * min(1.0, 2 - 2 * step / (settings.steps + 1))
        for k, x in g.items():
            x *= min(1.0, 1 / (norm + 1e-9))
            first[k] += 0.1 * (x - first[k])
            second[k] += 0.01 * (x * x - second[k])
            net.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, learn: Column, settings: Settings, id_col: str, text_col: str, lang_col: str) -> tuple[list[bytes], list[str]]:
    """Windows and labels of at most settings.texts texts of each language, the first by a hash. Only windows travel, and
    only of the texts whose hash is below a language's threshold, about four times as many as are taken."""
    text = docs[text_col].cast("string")
    h = F.xxhash64(docs[id_col], text, F.lit(1))
    places = [F.pmod(F.shiftright(h, 8 * k), F.greatest(F.char_length(text) - settings.window, F.lit(1))) + 1 for k in range(settings.windows)]
    cut_out = F.array(*(F.substring(text, p.cast("int"), F.lit(settings.window)) for p in places))
    rows = docs.where(learn & docs[lang_col].isNotNull() & F.coalesce(text.rlike(r"\p{L}"), F.lit(False))).select(docs[lang_col].cast("string").alias("lang"), h.alias("h"), cut_out.alias("windows"))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return [], []
    texts = max(8, min(settings.texts, settings.sampled // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 40, (4 * texts << 40) // r["count"])) for r in counts], "lang string, share long")
    few = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 40)) <= F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "windows"))
    found = few.withColumn("rank", rank).where(F.col("rank") <= texts).orderBy("lang", "rank").collect()
    pairs = [(w.encode(), r["lang"]) for r in found for w in dict.fromkeys(r["windows"])]
    return [w for w, _ in pairs], [x for _, x in pairs]


def identify(docs: DataFrame, held_out: Column | None = None, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; it learns from rows that have a label and are not held out.

    held_out: a condition on docs, by default crc32 of the id's text modulo 3 is 1. A null, empty or letterless text is
    "und" with score 0, as is every text when no labelled text has a letter. score is the pooled probability of lang_pred.
    A null label teaches nothing; repeated rows are predicted alike; an empty table gives no rows. Of the other columns
    only these three are read, and neither label nor id is an input of a prediction.
    """
    held_out = _held_out(docs, held_out, id_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out.alias("held_out"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    return label(rows, F.col("held_out"), settings, "doc_id", "text", "lang", ["doc_id", "held_out"])


def _held_out(docs: DataFrame, held_out: Column | None, id_col: str) -> Column:
    return F.coalesce(crc_bucket(docs[id_col], 3) == 1 if held_out is None else held_out, F.lit(False))


@tidy
def label(docs: DataFrame, held_out: Column | None = None, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """Every row of docs, with its columns (or those named) and two more at the end: identify()'s lang_pred and score, with
    underscores before names that docs has."""
    columns = docs.columns if columns is None else columns
    settings = settings or Settings()
    windows, labels = sample(docs, ~_held_out(docs, held_out, id_col), settings, id_col, text_col, lang_col)
    net = train(windows, labels, settings) if windows else None
    text, names = docs[text_col].cast("string"), [free_name(columns, x) for x in ("lang_pred", "score")]
    rows = docs.select(text.alias(free_name(columns, "_text")), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(free_name(columns, "_letters")), *(docs[c] for c in columns))

    def run(batches):
        for batch in batches:
            lettered = batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = raw(batch.column(0))
            for a, b in slices(offsets, 1 << 20):
                p = pooled(net, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) if net else None
                known = lettered[a:b] & (p.sum(1) > 0 if net else False)
                best = p.argmax(1) if net else np.zeros(b - a, np.int64)
                found = [net.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), known.tolist(), strict=True)] if net else [UNDETERMINED] * (b - a)
                score = np.where(known, np.minimum(p.max(1), 1.0), 0.0) if net else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[2:]), pa.array(found, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[2:], *names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[2:], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray, window: int = 64, block: int = 2048) -> np.ndarray:
    """Probabilities (rows, K) of texts, zero where no position votes. All positions are labelled."""
    size = np.diff(offsets)
    count = -(-size // window)
    row = np.repeat(np.arange(len(size)), count)
    start = np.repeat(offsets[:-1] - window * (np.cumsum(count) - count), count) + window * np.arange(len(row))
    total = np.zeros((len(net.languages), len(size)))
    votes = np.zeros(len(size))
    order = np.arange(window)[:, None]
    for k in range(0, len(row), block):
        own, first = row[k : k + block], start[k : k + block]
        at = first + order
        inside = at < offsets[own + 1]
        text = np.where(inside, data[np.minimum(at, len(data) - 1)], 32)
        voting = inside & _VOTES[text]
        p = net.labels(text)
        sums = (p * voting).sum(1)
        for j in range(len(total)):
            total[j] += np.bincount(own, sums[j], len(size))
        votes += np.bincount(own, voting.sum(0), len(size))
    return (total / np.maximum(votes, 1)).T
