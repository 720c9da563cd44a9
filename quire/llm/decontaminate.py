"""Benchmark decontamination by a generalised suffix automaton of the test items.

Test items are normalised to words (A-Z lower-cased, runs of digits, letters a-z and non-ASCII
characters). The automaton of at most PART_WORDS words of items, sorted arrays of some 160 MB at that size, is built on the
driver and sent to the executors; a larger benchmark is dealt by hash into such parts, through which the documents pass
one after another, each adding its hits. Documents stream through an automaton: at
each word the state's length is the longest match ending there. A match of at least ``window`` words
(or of a whole shorter item) marks its words as hit.

Before the automaton a mask of known word pairs skips stretches where no match of the shortest window
can lie; matches of two or more words lie wholly inside a stretch of known pairs, so nothing is lost.

Null and empty texts have no words. An item without words matches nothing; items that share an id
count once; an item without an id marks words but isn't listed. Rows are judged one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import few, materialise

WINDOW = 10
#: Words of one automaton: about 100 bytes each for the vocabulary, three edges of 12 bytes and two states of 12.
PART_WORDS = 1_000_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.window, self.vocab = window, {}
        self.frozen = False
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(key, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of((text or "").encode())]) for key, text in items]
        coded = [x for x in coded if x[1]]
        for _, item in coded:
            last = 0
            for c in item:
                last = self._extend(last, c)
        # the state that holds each window, with the items it stands for
        self.items: dict[int, set[str]] = defaultdict(set)
        self.at: dict[tuple[int, int], int] = {}
        self.shortest = min([window, *(len(item) for _, item in coded)])
        for key, item in coded:
            n = min(window, len(item))
            state = length = 0
            for c in item:
                state, length = self._step(state, length, c)
                if length >= n:
                    s = self._holds(state, n)
                    self.items[self.at.setdefault((s, n), len(self.at))].update([key] if key is not None else [])
        # on the way to the root, the windows that end wherever a state's words end
        self.short = defaultdict(list)
        for (s, n), k in self.at.items():
            self.short[s].append((n, k))
        # states without windows of their own share the list of the state above
        self.lists: list[tuple] = [()]
        ends = [0] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            ends[s] = ends[self.link[s]] if s else 0
            if s in self.short:
                self.lists.append(self.lists[ends[s]] + tuple(sorted(self.short[s])))
                ends[s] = len(self.lists) - 1
        self.ends = np.array(ends, np.int32)
        self.size = len(self.vocab) + 1
        bits = 22
        self.mask = (1 << bits) - 1
        self.pairs = np.zeros(1 << bits, bool)
        for _, item in coded:
            a = np.array(item, np.int64)
            self.pairs[(a[:-1] * 1_000_003 + a[1:]) & self.mask] = True
        self._freeze()

    def _freeze(self) -> None:
        """Edges as arrays sorted by state and word; the dicts of the build go."""
        n = sum(map(len, self.next))
        keys, to = np.empty(n, np.int64), np.empty(n, np.int32)
        at = 0
        for s, edges in enumerate(self.next):
            for c, t in edges.items():
                keys[at], to[at] = s * self.size + c, t
                at += 1
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.link, self.length = np.array(self.link, np.int32), np.array(self.length, np.int32)
        self.items, self.frozen = dict(self.items), True
        del self.next, self.short, self.at

    def _edge(self, state: int, c: int) -> int:
        """The state that a word leads to, or -1."""
        if not self.frozen:
            return self.next[state].get(c, -1)
        key = state * self.size + c
        i = int(self.keys.searchsorted(key))
        return int(self.to[i]) if i < len(self.keys) and self.keys[i] == key else -1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q])), self.link.append(self.link[q]), self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _step(self, state: int, length: int, c: int) -> tuple[int, int]:
        to = self._edge(state, c)
        while state and to < 0:
            state = int(self.link[state])
            length = int(self.length[state])
            to = self._edge(state, c)
        return (to, length + 1) if to >= 0 else (0, 0)

    def _holds(self, state: int, n: int) -> int:
        """The ancestor whose words include the last ``n`` of this state's."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges (first, past the last), disjoint and in order, and the windows found."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        runs = self._runs(ids)
        spans: list[list[int]] = []
        found: set[int] = set()
        for a, b in runs:
            state = length = 0
            for j, c in enumerate(ids[a:b].tolist(), a):
                state, length = self._step(state, length, c)
                best = 0
                for n, k in self.lists[self.ends[state]]:
                    if n <= length:
                        best = n
                        found.add(k)
                if not best:
                    continue
                lo = j + 1 - (length if length >= self.window and best == self.window else best)
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append([lo, j + 1])
        return [tuple(x) for x in spans], found

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        need = self.shortest
        if len(ids) < need or not self.vocab:
            return []
        if need == 1:
            ok = ids > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
            return list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        ok = (ids[:-1] > 0) & (ids[1:] > 0) & self.pairs[(ids[:-1] * 1_000_003 + ids[1:]) & self.mask]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        a, b = edges[::2], edges[1::2] + 1
        keep = b - a >= need
        return list(zip(a[keep].tolist(), b[keep].tolist()))

    def named(self, found: set[int]) -> list[str]:
        return sorted({x for k in found for x in self.items[k]})


@dataclass(frozen=True)
class Benchmark:
    """Test items (i, t) in parts, each with an automaton that is built when its turn comes."""

    items: DataFrame
    parts: int
    window: int

    def automaton(self, part: int) -> Automaton:
        mine = self.items if self.parts == 1 else self.items.where(F.pmod(F.xxhash64("i", "t"), F.lit(self.parts)) == part)
        return Automaton([tuple(r) for r in mine.select("i", "t").collect()], self.window)


def build(spark: SparkSession, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> Benchmark:
    """The test items, cut into as many parts as keep an automaton near PART_WORDS words."""
    some = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    size = some.agg(F.sum(F.regexp_count("t", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    return Benchmark(some, max(1, -(-size // PART_WORDS)), window)


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges in order that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _with_hits(docs: DataFrame, benchmark: Benchmark, text: str) -> DataFrame:
    """(row, spans, items): rows of ``docs`` as a struct with the hits of all parts, each part one pass over the rows written before."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = materialise(docs.select(whole, F.col(f"`{text}`").cast("binary").alias("t")).withColumn("k", F.monotonically_increasing_id()), "keyed")
    found = None
    for part in range(benchmark.parts):
        shared = docs.sparkSession.sparkContext.broadcast(benchmark.automaton(part))
        one = materialise(keyed.select("k", "t").mapInArrow(_hits(shared), "k long, spans array<struct<a:long,b:long>>, items array<string>"), f"hits{part}")
        shared.unpersist()
        found = one if found is None else found.union(one)
    each = found.groupBy("k").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return keyed.join(each, "k", "left").select("row", "t", "spans", "items")


def _hits(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = shared.value
        for batch in few(batches):
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                spans, found = sam.match(words_of(t.as_py() or b""))
                if spans:
                    rows.append((k, [{"a": a, "b": b} for a, b in spans], sam.named(found)))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), _SPANS, pa.list_(pa.string())))], ["k", "spans", "items"])

    return run


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _SPANS)])


def digest(docs: DataFrame, benchmark: Benchmark, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items (sorted ids), spans (hit word ranges)."""
    schema = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<a:long,b:long>>"
    many = benchmark.parts > 1
    if many:
        slim = _with_hits(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")), benchmark, "t").select("row.doc_id", "t", "spans", "items")
    else:
        shared = docs.sparkSession.sparkContext.broadcast(benchmark.automaton(0))
        slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = None if many else shared.value
        for batch in few(batches):
            rows = []
            for i, t in enumerate(batch.column(1)):
                words = words_of(t.as_py() or b"")
                if many:
                    spans = union_of([(x["a"], x["b"]) for x in batch.column(2)[i].as_py() or ()])
                    names = sorted(batch.column(3)[i].as_py() or ())
                else:
                    spans, found = sam.match(words)
                    names = sam.named(found)
                rows.append({"n_words": len(words), "n_hit": sum(b - a for a, b in spans), "n_items": len(names), "items": names, "spans": [{"a": a, "b": b} for a, b in spans]})
            cols = pa.array(rows, _RESULT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols.flatten()], ["doc_id", "n_words", "n_hit", "n_items", "items", "spans"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {schema}")


def sha256_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def clean(docs: DataFrame, benchmark: Benchmark, max_coverage: float = 0.2, text: str = "text") -> DataFrame:
    """Remove the hit spans; drop documents with over ``max_coverage`` of their words hit.

    A cut takes the text from the first to the last hit word; what lies around stays as it is. The
    columns are those of ``docs``; ``n_chars``, if there, follows the new text.
    """
    names = docs.columns
    many = benchmark.parts > 1
    if many:
        source = _with_hits(docs, benchmark, text).select("row.*", F.col("spans").alias("_spans"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(benchmark.automaton(0))
        source = docs
    at = names.index(text)

    def cut(t: bytes | None, spans: list[tuple[int, int]], n: int) -> tuple[bool, bytes | None]:
        if not spans:
            return True, t
        if sum(b - a for a, b in spans) > max_coverage * n:
            return False, t
        places = [m.span() for m in _WORD.finditer(t.lower())]
        out, done = [], 0
        for a, b in spans:
            out.append(t[done : places[a][0]])
            done = places[b - 1][1]
        return True, b"".join([*out, t[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = None if many else shared.value
        for batch in few(batches):
            done = []
            for i, t in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                words = words_of(t or b"")
                spans = union_of([(x["a"], x["b"]) for x in batch.column(len(names))[i].as_py() or ()]) if many else sam.match(words)[0]
                done.append(cut(t, spans, len(words)))
            cols = list(batch.columns)[: len(names)]
            cols[at] = pa.array([x[1] for x in done], pa.binary()).cast(pa.string())
            keep = pa.array([x[0] for x in done], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([pa.field(n, c.type) for n, c in zip(names, cols)])).filter(keep)

    out = source.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in names and text != "n_chars" else out
