"""Encoding and decoding with a BPE vocabulary whose words end in a suffix symbol, by a minimal acyclic transducer.

The corpus's frequent words are compiled on the driver into a minimal acyclic automaton with shared prefixes and
suffixes. Each transition carries how many accepted words sort before its branch, so the sum along a path is the word's
number, whose ids stand in a table. The arrays go to a file in the shared folder, which Spark hands to every executor and
the workers memory-map; a batch's distinct words walk through it together, one byte at a time. Words that it lacks are
merged exactly, lowest rank first. Words count as the same when their bytes are.
"""

from __future__ import annotations

import functools
import hashlib
import io
import json
import os
import re
import unicodedata
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forms, kept, mix64, most_frequent, shared_dir, slices, span_hashes, tidy

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
#: Words that are compiled, and bytes of the longest: the bound of the lexicon's size. Other words are merged.
LEXICON_WORDS, LEXICON_BYTES = 1 << 18, 64
#: Bytes from which a word is merged by itself.
LONG = 64
_CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_BLANKS = "\t\n\x0b\x0c\r\x20\x85\xa0                　"


@functools.cache
def _class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))
        out[cp] = UNKNOWN if c == "Cn" else kinds.get(c[0], OTHER)
    out[[ord(c) for c in _BLANKS]] = SPACE
    out.setflags(write=False)
    return out


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """A tokenizer file's vocabulary, merges and special tokens."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        self.inner = [vocab[c] for c in byte_alphabet()]
        self.last = [vocab[c + suffix] for c in byte_alphabet()]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = vocab | self.special
        self.tokens = [""] * (max(tokens.values()) + 1)
        for token, k in tokens.items():
            self.tokens[k] = token

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: again and again the leftmost pair of lowest rank becomes one symbol."""
        ids, ranks, none = [*(self.inner[b] for b in word[:-1]), self.last[word[-1]]], self.ranks, (1 << 30, 0)
        found = [ranks.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found))[0] < none[0]:
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = ranks.get((ids[k - 1], ids[k]), none)
            if k < len(found):
                found[k] = ranks.get((ids[k], ids[k + 1]), none)
        return ids


def merge_long(vocabulary: Vocabulary, word: bytes) -> list[int]:
    """As merge(), in n log n steps by a heap over a linked list, for very long words."""
    import heapq

    ids, n = [*(vocabulary.inner[b] for b in word[:-1]), vocabulary.last[word[-1]]], len(word)
    after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

    def push(k: int) -> None:
        if k >= 0 and after[k] >= 0 and (hit := vocabulary.ranks.get((ids[k], ids[after[k]]))):
            heapq.heappush(heap, (hit[0], k, hit[1], ids[k], ids[after[k]]))

    for k in range(n):
        push(k)
    while heap:
        _, k, new, left, right = heapq.heappop(heap)
        if ids[k] == left and (m := after[k]) >= 0 and ids[m] == right:
            ids[k], ids[m], after[k] = new, -1, after[m]
            if after[m] >= 0:
                before[after[m]] = k
            push(before[k])
            push(k)
    return [x for x in ids if x >= 0]


class Merges:
    """Vocabulary.merge() for many words together: each step merges the best pair of every word that still has one."""

    NONE = np.int32(1 << 30)

    def __init__(self, vocabulary: Vocabulary):
        pairs = sorted(((a << 32 | b), k, new) for (a, b), (k, new) in vocabulary.ranks.items())
        self.keys = np.array([x[0] for x in pairs] or [-1], np.int64)
        self.rank = np.array([x[1] for x in pairs] or [self.NONE], np.int32)
        self.new = np.zeros(len(pairs) + 1, np.int32)
        self.new[self.rank[: len(pairs)]] = [x[2] for x in pairs]
        self.inner, self.last = np.array(vocabulary.inner, np.int32), np.array(vocabulary.last, np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | np.maximum(b, 0)
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[k] == key) & (a >= 0) & (b >= 0), self.rank[k], self.NONE)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words data[start:end], one after the other, and how many each has; for words of ordinary length."""
        n = end - start
        order = np.argsort(n, kind="stable")
        lengths, parts = np.zeros(len(n), np.int64), [np.zeros(0, np.int32)]
        for at in range(0, len(order), 2048):
            own = order[at : at + 2048]
            ids = self._block(data, start[own], n[own])
            full = ids >= 0
            lengths[own] = full.sum(1)
            parts.append(ids[full])
        first = np.zeros(len(n), np.int64)
        first[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(parts)[_ranges(first, lengths)], lengths

    def _block(self, data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        wide = int(n.max()) + 1
        column = np.arange(wide, dtype=np.int32)
        ids = np.full((len(n), wide), -1, np.int32)
        ids[column < n[:, None]] = self.inner[data[_ranges(start, n)]]
        ids[np.arange(len(n)), n - 1] = self.last[data[start + n - 1]]
        done, live = ids, np.arange(len(n))
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            best = rank.argmin(1).astype(np.int32)
            found = rank[np.arange(len(best)), best]
            go = found < self.NONE
            if not go.all():
                done[live[~go]] = ids[~go]
                live, ids, rank, best, found = live[go], ids[go], rank[go], best[go], found[go]
            if not len(live):
                return done
            behind = column > best[:, None]  # these symbols, and the pairs that they begin, move up by one
            next_ids, next_rank = np.full_like(ids, -1), np.full_like(rank, self.NONE)
            next_ids[:, :-1], next_rank[:, :-1] = ids[:, 1:], rank[:, 1:]
            ids, rank = np.where(behind, next_ids, ids), np.where(behind[:, :-1], next_rank, rank)
            row = np.arange(len(live))
            ids[row, best] = self.new[found]
            rank[row, best] = self.ranks(ids[row, best], ids[row, best + 1])
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.ranks(ids[left, best[left] - 1], ids[left, best[left]])


def merged(vocabulary: Vocabulary, merges: Merges, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words data[start:end], one after the other, and how many each has."""
    long = end - start >= LONG
    lengths = np.zeros(len(start), np.int64)
    short, lengths[~long] = merges.of(data, start[~long], end[~long])
    if not long.any():
        return short, lengths
    own = [merge_long(vocabulary, data[a:b].tobytes()) for a, b in zip(start[long], end[long], strict=True)]
    lengths[long] = [len(x) for x in own]
    at, flat = np.cumsum(lengths) - lengths, np.empty(lengths.sum(), np.int32)
    flat[_ranges(at[~long], lengths[~long])] = short
    flat[_ranges(at[long], lengths[long])] = [y for x in own for y in x]
    return flat, lengths


@functools.cache
def tables(path: str) -> tuple[Vocabulary, Merges]:
    """What a tokenizer file says, read once a worker process instead of once a task."""
    vocabulary = Vocabulary(path)
    return vocabulary, Merges(vocabulary)


@dataclass
class Words:
    """Words of some texts: their bytes in data from start to end, each one's row, and the special tokens' ids (else -1)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    special: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Splitter:
    """Normalises texts and cuts them into words as the tokenizer file does."""

    def __init__(self, vocabulary: Vocabulary):
        self.classes = _class_table()
        self.vocabulary, self.marks = vocabulary, re.compile("|".join(map(re.escape, vocabulary.special)) or r"(?!)")
        self._library = None

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.vocabulary.path)
        return self._library

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)  # white space of any kind only parts words, so it needn't become U+0020
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def pieces(self, text: str):
        """Normalised bytes between special tokens, and these tokens' ids."""
        if "<|" not in text or not self.marks.search(text):
            yield self.normal(text).encode(), -1
            return
        at = 0
        for m in self.marks.finditer(text):
            yield self.normal(text[at : m.start()]).encode(), -1
            yield m[0].encode(), self.vocabulary.special[m[0]]
            at = m.end()
        yield self.normal(text[at:]).encode(), -1

    def words(self, texts: list[str]) -> Words:
        parts, rows, marks = [], [], []
        for row, text in enumerate(texts):
            for part, mark in self.pieces(text):
                if part:
                    parts.append(part)
                    rows.append(row)
                    marks.append(mark)
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(lengths + 1) - lengths - 1
        kind = self.classes[data]
        heads = None
        if len(high := np.flatnonzero(data >= 0xC0)):
            lead = data[high].astype(np.int64)
            tail = [data[np.minimum(high + k, len(data) - 1)].astype(np.int64) & 63 for k in (1, 2, 3)]
            cp = np.where(lead < 0xE0, (lead & 31) << 6 | tail[0], np.where(lead < 0xF0, (lead & 15) << 12 | tail[0] << 6 | tail[1], (lead & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
            of = self.classes[cp]
            kind = np.where(data < 0x80, kind, OTHER)
            kind[high] = of
            for k in (1, 2, 3):
                more = high[lead >= (0xC0, 0xE0, 0xF0)[k - 1]]
                kind[more + k] = kind[more]
            heads = (data & 0xC0) != 0x80
        for k, mark in enumerate(marks):
            if mark >= 0:
                kind[first[k] : first[k] + lengths[k]] = OTHER
        odd = {rows[k] for k in np.searchsorted(first, np.flatnonzero(kind == UNKNOWN), "right") - 1} if (kind == UNKNOWN).any() else set()
        number = kind == NUMBER
        changed = np.ones(len(data), bool)
        changed[1:] = (kind[1:] != kind[:-1]) | (number[1:] if heads is None else number[1:] & heads[1:])
        quotes = np.flatnonzero((data == 0x27) & changed)
        if len(quotes):
            quotes = quotes[(quotes + 1 < len(data)) & changed[np.minimum(quotes + 1, len(data) - 1)]]
            text, joined, split = data.tobytes(), [], []
            for q in quotes.tolist():
                for c in _CONTRACTIONS:
                    if text.startswith(c, q + 1):
                        joined.append(q + 1)
                        split.append(q + 1 + len(c))
                        break
            changed[joined] = False
            again = np.array(split, np.int64)
            changed[again[again < len(data)]] = True
        edges = np.append(np.flatnonzero(changed), len(data))
        start, end = edges[:-1], edges[1:]
        solid = kind[start] != SPACE
        start, end = start[solid], end[solid]
        part = np.searchsorted(first, start, "right") - 1
        row, special = np.array(rows, np.int64)[part] if rows else part, np.array(marks, np.int64)[part] if marks else part
        if odd:
            return self._with_library(texts, odd, Words(data, start, end, row, special))
        whole = special >= 0
        if whole.any():
            keep = ~whole | (start == first[part])
            end = np.where(whole, (first + lengths)[part], end)
            start, end, row, special = start[keep], end[keep], row[keep], special[keep]
        return Words(data, start, end, row, special)

    def _with_library(self, texts: list[str], odd: set[int], rest: Words) -> Words:
        """Texts with characters newer than Python's Unicode tables: the library normalises and cuts these."""
        back = {c: b for b, c in enumerate(byte_alphabet())}
        keep = ~np.isin(rest.row, list(odd))
        buf, at, out = [rest.data.tobytes()], len(rest.data), []
        for row in sorted(odd):
            last = 0
            spots = [*((m.start(), m.end(), self.vocabulary.special[m[0]]) for m in self.marks.finditer(texts[row])), (len(texts[row]), 0, -1)]
            for a, b, mark in spots:
                normal = self.library().normalizer.normalize_str(texts[row][last:a])
                cut = [(bytes(back[c] for c in w), -1) for w, _ in self.library().pre_tokenizer.pre_tokenize_str(normal)]
                for w, m in [*cut, *([(texts[row][a:b].encode(), mark)] if mark >= 0 else [])]:
                    buf.append(w)
                    out.append((at, at + len(w), row, m))
                    at += len(w)
                last = b
        more = np.array(out, np.int64).reshape(-1, 4)
        start, end, row, special = (np.concatenate([a[keep], more[:, k]]) for k, a in enumerate((rest.start, rest.end, rest.row, rest.special)))
        order = np.argsort(row, kind="stable")
        return Words(np.frombuffer(b"".join(buf), np.uint8), start[order], end[order], row[order], special[order])


def compile_lexicon(words: list[bytes], vocabulary: Vocabulary) -> bytes:
    """The minimal transducer of distinct words, as a file of arrays."""
    words = sorted(words)
    register: dict[tuple, int] = {}
    edges: list[tuple[tuple[int, int], ...]] = []
    final: list[bool] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(edges)
            edges.append(key[1])
            final.append(node[0])
        return register[key]

    path_nodes: list[list] = [[False, []]]
    last = b""
    for w in words:
        common = len(os.path.commonprefix((w, last)))
        while len(path_nodes) - 1 > common:
            done = settle(path_nodes.pop())
            path_nodes[-1][1].append((last[len(path_nodes) - 1], done))
        path_nodes += [[False, []] for _ in range(len(w) - common)]
        path_nodes[-1][0] = True
        last = w
    while len(path_nodes) > 1:
        done = settle(path_nodes.pop())
        path_nodes[-1][1].append((last[len(path_nodes) - 1], done))
    root = settle(path_nodes[0])
    below = [0] * len(edges)
    keys, to, before = [], [], []
    for state, own in enumerate(edges):  # children come before their parents
        n = int(final[state])
        for byte, child in own:
            keys.append(state << 8 | byte)
            to.append(child)
            before.append(n)
            n += below[child]
        below[state] = n
    size = 1 << max(4, (3 * len(keys)).bit_length())
    slot_key, slot_to, slot_out = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
    key, to_, out_ = np.array(keys, np.int64), np.array(to, np.int32), np.array(before, np.int32)
    at, left = (mix64(key.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64), np.arange(len(keys))
    while len(left):
        free = left[slot_key[at[left]] < 0]
        _, one = np.unique(at[free], return_index=True)
        won = free[one]
        slot_key[at[won]], slot_to[at[won]], slot_out[at[won]] = key[won], to_[won], out_[won]
        left = left[slot_key[at[left]] != key[left]]
        at[left] = (at[left] + 1) & (size - 1)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    flat, lengths = merged(vocabulary, Merges(vocabulary), np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    out = io.BytesIO()
    for a in (np.array([root, size, len(edges), len(words), len(flat)], np.int64), slot_key, slot_to, slot_out, np.array(final, np.int32), offsets, flat):
        out.write(a.tobytes())
    return out.getvalue()


class Lexicon:
    """The compiled transducer, memory-mapped."""

    def __init__(self, path: str):
        m = np.asarray(np.memmap(path, np.uint8, "r"))
        self.root, size, states, self.n, flat = (int(x) for x in m[:40].view(np.int64))
        at = 40

        def take(kind, n):
            nonlocal at
            out = m[at : at + n * np.dtype(kind).itemsize].view(kind)
            at += n * np.dtype(kind).itemsize
            return out

        self.mask = np.uint64(size - 1)
        self.key, self.to, self.out, self.final, self.offsets, self.flat = take(np.int64, size), take(np.int32, size), take(np.int32, size), take(np.int32, states), take(np.int32, self.n + 1), take(np.int32, flat)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each word's number, or -1."""
        number = np.full(len(start), -1, np.int64)
        live, state, total = np.arange(len(start)), np.full(len(start), self.root, np.int64), np.zeros(len(start), np.int64)
        depth = 0
        while len(live):
            over = start[live] + depth >= end[live]
            if over.any():
                ended = over & (self.final[state] > 0)
                number[live[ended]] = total[ended]
                live, state, total = live[~over], state[~over], total[~over]
            key = state << 8 | data[start[live] + depth]
            slot = (mix64(key.astype(np.uint64)) & self.mask).astype(np.int64)
            got = self.key[slot]
            while len(moved := np.flatnonzero((got != key) & (got >= 0))):
                slot[moved] = (slot[moved] + 1) & int(self.mask)
                got[moved] = self.key[slot[moved]]
            hit = got == key
            live, slot = live[hit], slot[hit]
            state, total = self.to[slot].astype(np.int64), total[hit] + self.out[slot]
            depth += 1
        return number


@dataclass
class Encoded:
    """Ids of some texts: row k has ids[offsets[k]:offsets[k+1]]; its words
    are form[word_offsets[k]:word_offsets[k+1]], and form f has the ids flat[at[f]:at[f+1]]."""

    ids: np.ndarray
    offsets: np.ndarray
    form: np.ndarray
    word_offsets: np.ndarray
    flat: np.ndarray
    at: np.ndarray

    def forms(self) -> list[list[int]]:
        flat, at = self.flat.tolist(), self.at.tolist()
        return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


class Encoder:
    def __init__(self, tokenizer_path: str, lexicon_path: str):
        self.vocabulary, self.merges = tables(tokenizer_path)
        self.splitter, self.lexicon = Splitter(self.vocabulary), Lexicon(lexicon_path)

    def encode(self, texts: list[str]) -> Encoded:
        w = self.splitter.words(texts)
        keys, special = span_hashes(w.data, w.start, w.end), w.special >= 0
        if special.any():  # apart from the word with the same bytes
            keys[special] = mix64(w.special[special].astype(np.uint64) | np.uint64(1 << 62))
        form, first = forms(w.data, w.start, w.end, keys)
        start, end, special = w.start[first], w.end[first], w.special[first]
        number = np.where(special >= 0, -1, self.lexicon.find(w.data, start, end))
        known, offsets = number >= 0, self.lexicon.offsets
        lengths = np.zeros(len(first), np.int64)
        lengths[known] = (offsets[number[known] + 1] - offsets[number[known]]).astype(np.int64)
        rare = ~known & (special < 0)
        fresh, lengths[rare] = merged(self.vocabulary, self.merges, w.data, start[rare], end[rare])
        lengths[special >= 0] = 1
        at = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.empty(at[-1], np.int32)
        flat[_ranges(at[:-1][known], lengths[known])] = self.lexicon.flat[_ranges(offsets[number[known]].astype(np.int64), lengths[known])]
        flat[_ranges(at[:-1][rare], lengths[rare])] = fresh
        flat[at[:-1][special >= 0]] = special[special >= 0]
        ids = flat[_ranges(at[:-1][form], lengths[form])]
        per_word = np.concatenate([[0], np.cumsum(lengths[form])])
        word_offsets = np.searchsorted(w.row, np.arange(len(texts) + 1))
        return Encoded(ids, per_word[word_offsets], form, word_offsets, flat, at)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... length[0] of them, then those from start[1], and so on."""
    if not len(start):
        return np.zeros(0, np.int64)
    total = np.cumsum(length)
    return np.repeat(start - (total - length), length) + np.arange(total[-1])


def count_words(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """word (binary) and n, its occurrences in all texts; special tokens don't count."""

    def run(batches):
        splitter = Splitter(tables(tokenizer_path)[0])
        for batch in batches:
            lengths = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(np.concatenate([[0], np.cumsum(lengths)]), 4 << 20):
                w = splitter.words([x or "" for x in batch.column(0).slice(a, b - a).to_pylist()])
                if not len(w.start):
                    continue
                plain = w.special < 0
                start, end = w.start[plain], w.end[plain]
                form, first = forms(w.data, start, end, span_hashes(w.data, start, end))
                lengths_ = (end - start)[first]
                body = w.data[_ranges(start[first], lengths_)].tobytes()
                at = np.concatenate([[0], np.cumsum(lengths_)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(body)]), pa.array(np.bincount(form, minlength=len(first)).astype(np.int64))], ["word", "n"])

    text = docs[text_col].cast("string")
    return docs.select(text.alias("text"), F.octet_length(text).alias("bytes")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words of all texts, limit of them, and hands the file to the executors. Its name there.

    Counts come from every text; equally frequent words are chosen by a hash. Words of over LEXICON_BYTES stay out.
    """
    spark = docs.sparkSession
    counts = kept(count_words(docs, tokenizer_path, text_col).where(F.octet_length("word") <= LEXICON_BYTES))
    frequent = most_frequent(counts, "n", F.xxhash64("word"), limit).select("word").toArrow().column(0).to_pylist()
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = f"{shared_dir(spark)}/{name}"
    _put(spark, path, compile_lexicon([bytes(w) for w in frequent], tables(tokenizer_path)[0]))
    spark.sparkContext.addFile(path)
    return name


def _put(spark: SparkSession, path: str, body: bytes) -> None:
    """Writes a file through Hadoop's file systems, to whatever store the shared folder is in."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    try:
        for k in range(0, len(body), 1 << 20):
            out.write(bytearray(body[k : k + (1 << 20)]))
    finally:
        out.close()


def encode_with(rows: DataFrame, lexicon: str, tokenizer_path: str, emit, schema: str) -> DataFrame:
    """mapInArrow over rows (key, text): emit(encoder, keys of the rows, encoded) gives a record batch for each slice of rows."""

    def run(batches):
        encoder = Encoder(tokenizer_path, SparkFiles.get(lexicon))
        for batch in batches:
            lengths = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(np.concatenate([[0], np.cumsum(lengths)])):
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                yield emit(encoder, batch.column(0).slice(a, b - a), encoder.encode(texts))

    return rows.select("key", "text", F.octet_length("text").alias("bytes")).mapInArrow(run, schema)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].cast("string").alias("text"))


@tidy
def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of each row, as the tokenizers library gives them without added special tokens.

    A null text counts as empty and has no ids. Repeated rows and rows without an id are encoded like any other; very long
    texts make a slice of their own; an empty table gives no rows; other columns are not read.
    """
    lexicon = build_lexicon(docs, tokenizer_path, text_col)

    def emit(encoder, doc_ids, e):
        return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(e.offsets.astype(np.int32)), pa.array(e.ids))], ["doc_id", "ids"])

    return encode_with(_keyed(docs, id_col, text_col), lexicon, tokenizer_path, emit, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text: each id's token, joined by a space, as the library decodes with a file that names no decoder. Null ids: empty."""

    def run(batches):
        tokens = tables(tokenizer_path)[0].tokens
        for batch in batches:
            texts = [" ".join([tokens[k] for k in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


@tidy
def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode() and decode(), joined up form by form instead of id by id."""
    lexicon = build_lexicon(docs, tokenizer_path, text_col)

    def emit(encoder, doc_ids, e):
        tokens, n = encoder.vocabulary.tokens, len(e.offsets) - 1
        forms = e.forms()
        numbers, texts = np.empty(len(forms), object), np.empty(len(forms), object)
        numbers[:] = [" ".join(map(str, x)) for x in forms]
        texts[:] = [" ".join([tokens[k] for k in x]) for x in forms]
        cols: list[list[str]] = [[], []]
        for k in range(n):
            own = e.form[e.word_offsets[k] : e.word_offsets[k + 1]]
            for col, of in zip(cols, (numbers, texts), strict=True):
                col.append(hashlib.sha256(" ".join(of[own].tolist()).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(e.offsets).astype(np.int64)), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_with(_keyed(docs, id_col, text_col), lexicon, tokenizer_path, emit, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
