"""Exact Jaccard join of word-shingle sets in metric space.

Sets at Jaccard similarity s >= 0.8 are at distance d = 1 - s <= 0.2, and d is a metric. Documents that
share no shingle are at distance 1, where no pivot tells them apart; they are kept apart by what every
linked pair must share: of its n shingles in one fixed order, one of the first n - ceil(0.8 n) + 1. The
rest is done by pivots:

1. Documents with equal sets are one class (128-bit key); classes are joined from here on.
2. Each class emits its first shingles. Those met in the first places of two classes are ordered after all others, and
   frequent ones last: classes that have only a phrase in common then share none. A group that shares one is spanned by
   stars: in groups of at most SMALL between classes whose lengths and places allow a link, in larger ones
   between classes whose lengths do. A group gives fewer edges than it has rows, and the groups of frequent
   shingles are dealt over several tasks. What stars connect is a region: all links lie inside regions.
3. A region of over SHARE shingles is split, whatever its size, over tasks of about SHARE shingles each:
   PIVOTS of its classes, the most central of a sample, meet all its members. A member within 0.2 of a pivot is linked with it and belongs to the
   nearest one's Voronoi cell. By the triangle inequality a class that is linked with a member of cell p
   is within 0.4 of p: classes in that window that no link connects with p yet are replicated to the cell, and
   cells with such guests are solved, cut into blocks where they exceed SHARE. Classes that no pivot is
   near to are the next round's region, recursively; whatever links two of them is found there. A region of
   which a round leaves over seven eighths is one that pivots don't part; it is cut into blocks of which every pair meets, whole
   or by groups that share one of their first shingles, whichever compares less.
4. In a task pivots are processed one after another: their distances to all members give links, and
   |d(x, p) - d(y, p)| > 0.2 rules out pairs. It ends when no pair of unlinked parts can be within 0.2.
5. Links become components by minimum labels with pointer jumping.

The order of shingles is a matter of speed only: any order gives the same links. Regions are named by 64-bit
hashes, where a collision makes a region larger and nothing else.

A text's words are its runs of characters other than ASCII white space, A-Z lower-cased; a shingle is
five words, and a text of fewer words is one shingle. Null and empty texts have an empty set and link
with nothing. Rows that repeat an id, or have none, count as documents of their own; a component's id is
its smallest id. Ids may be of any ordered type.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from quire.llm.common import few, heavy_keys, marked, marks, materialise, salted_join

SHINGLE = 5
SMALL = 32
SHARE = 262_144
ROUNDS = 8
SAMPLE = 64
HOT_SHINGLES = 1_000_000
PIVOTS = 8
SALTED = 4_096
#: Shingles that a task of ``signatures`` holds before it counts those that came again.
WAITING = 6_000_000
#: Bits that tell which shingles were met twice, 16 MB, and shingles of all sets for each task that finds them.
MET, DEALT = 1 << 27, 1_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


#: Odd multipliers, one for each place of a shingle: powers of one.
_PLACES = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(SHINGLE)]


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20
_LENGTH = np.uint64(0xA24BAED4963EE407)


@lru_cache(1 << 16)
def _long_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and places of the words of some lower-case bytes.

    A word of up to eight bytes is the number that they are, mixed, so no two share a hash but by its length; a longer one has a
    digest, as no sum of its letters would tell all words apart.
    """
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACES[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    # eight bytes from every place, of which a word keeps its own
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))[starts].astype(np.uint64)
    eight &= ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * np.minimum(size, 8).astype(np.uint64))
    h = _mix(_mix(eight) + size.astype(np.uint64) * _LENGTH)
    for k in np.flatnonzero(size > 8).tolist():
        h[k] = _long_hash(data[starts[k] : ends[k]])
    return h, starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """Stretches of about PIECE bytes that end between words."""
    at = 0
    while at < len(data):
        found = _GAP.search(data, at + PIECE)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def shingle_sets(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text; texts are hashed together, a megabyte at a time."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if len(held) == 1:
            found = [word_hashes(p)[0] for p in _pieces(held[0])]
            ids = np.concatenate(found) if found else np.empty(0, np.uint64)
            cuts = [0, len(ids)]
        else:
            ids, starts = word_hashes(b"\n".join(held))
            cuts = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in held])).tolist()
        full = np.zeros(max(0, len(ids) - SHINGLE + 1), np.uint64)
        for k, m in enumerate(_PLACES):
            full += ids[k : k + len(full)] * m
        full = _mix(full).view(np.int64)
        for a, b in zip(cuts, cuts[1:]):
            n = b - a
            if n >= SHINGLE:
                yield distinct(full[a : b - SHINGLE + 1])
            elif n:
                whole = np.array([(ids[a:b] * np.array(_PLACES[:n])).sum()], np.uint64)
                yield _mix(whole + np.uint64(n)).view(np.int64)
            else:
                yield np.empty(0, np.int64)

    for t in texts:
        t = (t or b"").lower()
        if held and size + len(t) > PIECE:
            yield from flush()
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield from flush()


def shingles(text: bytes | None) -> np.ndarray:
    return next(shingle_sets([text]))


def key_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def node_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes | None]:
    return (x.as_py() for x in batch.column(column))


def repeated(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that come more than once, in order, and how often. Sorts ``hashes`` in place, so it holds no copy of them."""
    hashes.sort()
    edges = np.diff((hashes[1:] == hashes[:-1]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts = np.flatnonzero(edges == 1)
    return hashes[starts], np.flatnonzero(edges == -1) - starts + 1


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Kind 0: (id, n, key, node) of each document. Kind 1: (node: shingle, n: sets with it) as seen by one task, from 2."""
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("t"))
    names = ["kind", "id", "n", "key", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting, size, counts, id_type = set(), np.empty(WAITING, np.int64), 0, (np.empty(0, np.int64), np.empty(0, np.int64)), None

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = repeated(waiting[:size])
            if len(counts[0]):
                keys, where = np.unique(np.concatenate((counts[0], keys)), return_inverse=True)
                n = np.bincount(where, np.concatenate((counts[1], n)), len(keys)).astype(np.int64)
            if len(keys) > HOT_SHINGLES:
                top = np.sort(np.argpartition(-n, HOT_SHINGLES)[:HOT_SHINGLES])
                keys, n = keys[top], n[top]
            return keys, n

        for batch in few(batches):
            n, keys, id_type = [], [], batch.column(0).type
            for s in shingle_sets(_texts(batch, 1)):
                n.append(len(s))
                key = key_of(s) if len(s) else None
                keys.append(key)
                if len(s) and key not in seen:
                    if len(seen) < 500_000:
                        seen.add(key)
                    if size + len(s) > WAITING:
                        counts, size = merged(), 0
                    if len(s) <= WAITING:  # no shingle of a set comes again in it
                        waiting[size : size + len(s)] = s
                        size += len(s)
            nodes = [None if k is None else node_of(k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(nodes, pa.int64())], names)
        keys, n = merged()
        for k in range(0, len(keys), 100_000):
            part = slice(k, k + 100_000)
            m = len(keys[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, id_type), pa.array(n[part]), pa.nulls(m, pa.binary()), pa.array(keys[part])], names)

    return slim.mapInArrow(run, f"kind int, id {slim.schema['id'].dataType.simpleString()}, n long, key binary, node long")


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most HOT_SHINGLES shingles, the most frequent, sorted, and twice the logarithm of how many sets have each."""
    top = counts.groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(HOT_SHINGLES).toArrow()
    keys, n = (top.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(keys)
    return keys[order], np.minimum(np.log2(n[order] + 1) * 2, 100).astype(np.uint8)


def _ordered(batches: Iterator[pa.RecordBatch], hot: tuple[np.ndarray, np.ndarray], met: np.ndarray | None = None) -> Iterator[list[tuple]]:
    """Of some texts at a time (node, n, take, s, rank) of each set, once per task: its shingles in order, of rank 0 if neither met
    nor frequent, and how many of them a linked set must share one of."""
    seen, (late, level) = set(), hot
    maybe = np.zeros(1 << 22, bool)
    maybe[late & (len(maybe) - 1)] = True
    for batch in few(batches):
        out = []
        for s in shingle_sets(_texts(batch, 0)):
            if not len(s) or (key := key_of(s)) in seen:
                continue
            if len(seen) < 500_000:
                seen.add(key)
            n = len(s)
            rank = np.zeros(n, np.uint8)
            if met is not None:
                at = s & (8 * len(met) - 1)
                rank[:] = (met[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            some = np.flatnonzero(maybe[s & (len(maybe) - 1)])
            if len(some):
                at = np.minimum(np.searchsorted(late, s[some]), len(late) - 1)
                rank[some] = np.where(late[at] == s[some], level[at], rank[some])
            if rank.any():
                order = np.argsort(rank, kind="stable")
                s, rank = s[order], rank[order]
            out.append((node_of(key), n, n - (4 * n + 4) // 5 + 1, s, rank))
        yield out


def met_twice(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], shingles: int, text: str = "text") -> np.ndarray:
    """Bits at the hashes of shingles that come twice among the first of all sets, of each twice as many as ``prefixes`` takes.

    With these ordered last, a set of which half of them are nowhere else shares none of those taken. ``shingles`` is their
    number in all sets; bits are at most MET. They only order what is compared.
    """
    size = min(MET, max(1 << 20, 1 << (max(1, shingles // 4) - 1).bit_length()))
    buckets = min(4_096, max(8, 1 << (max(1, shingles // DEALT) - 1).bit_length()))
    each = size // buckets
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    slim = docs.select(F.col(text).cast("binary").alias("t"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _ordered(batches, shared.value):
            first = [s[: 2 * take][rank[: 2 * take] == 0] for _, _, take, s, rank in some]
            if first:
                s = np.concatenate(first)
                bucket = (s & (size - 1)) // each
                s = s[np.argsort(bucket.astype(np.int16), kind="stable")]
                ends = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
                parts = [(k, s[a:b].tobytes()) for k, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["bucket", "s"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        held: dict[int, list[np.ndarray]] = {}
        total: dict[int, int] = {}

        def settle(k: int) -> None:
            s = np.concatenate(held.pop(k, [np.empty(0, np.int64)]))
            bits.setdefault(k, np.zeros(each, bool))[repeated(s)[0] & (each - 1)] = True
            total[k] = 0

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = np.frombuffer(data.as_buffer(), np.int64)
                held.setdefault(k, []).append(s)
                total[k] = total.get(k, 0) + len(s)
                if total[k] > 8 * DEALT:  # what comes again after this goes unseen, which changes no link
                    settle(k)
        for k in bits | held:
            settle(k)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits[k], bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])

    dealt = slim.mapInArrow(deal, "bucket int, s binary").repartition(buckets, "bucket")
    rows = materialise(dealt.mapInArrow(mark, "bucket int, bits binary"), "met_twice").toArrow()
    out = np.zeros(size // 8, np.uint8)
    for k, data in zip(rows.column("bucket").to_pylist(), rows.column("bits")):
        out[k * each // 8 : (k + 1) * each // 8] = np.frombuffer(data.as_buffer(), np.uint8)
    return out


def prefixes(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], text: str = "text", met: np.ndarray | None = None) -> DataFrame:
    """(shingle, salt, node, place): the first n - ceil(0.8 n) + 1 shingles of each set, once per task.

    ``place`` holds n in its upper and the shingle's place in its lower 32 bits. A shingle of over SALTED sets is
    dealt over as many salts, from 1, as keep a group near that size; others have salt 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast((hot, met))
    slim = docs.select(F.col(text).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _ordered(batches, *shared.value):
            out, ranks = [s[:take] for _, _, take, s, _ in some], [rank[:take] for _, _, take, _, rank in some]
            nodes, places = [x[0] for x in some], [(n << 32) + np.arange(take) for _, n, take, _, _ in some]
            if out:
                node = np.repeat(np.array(nodes, np.int64), [len(x) for x in out])
                salts = (np.exp2(np.concatenate(ranks) / 2.0) / SALTED).astype(np.int64)
                salt = np.where(salts > 1, 1 + np.abs(node % np.maximum(salts, 1)), 0)
                cols = [np.concatenate(out), salt, node, np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shingle", "salt", "node", "place"])

    return slim.mapInArrow(run, "shingle long, salt long, node long, place long")


def _stars(x: np.ndarray, y: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Edges (smallest node of its part, node) of the parts that pairs of places (x, y) connect."""
    label = np.arange(len(node))
    while len(x):
        low = np.minimum(label[x], label[y])
        if (label[x] == low).all() and (label[y] == low).all():
            break
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
    least = node.copy()
    np.minimum.at(least, label, node)
    centre = least[label]
    own = centre != node
    return np.stack((centre[own], node[own]), 1)


def candidates(rows: DataFrame) -> DataFrame:
    """Edges (a, b) of stars that span each group of classes with a common first shingle; fewer than rows.

    Groups stream past: of one that is still open at the end of a batch at most SMALL rows are held, and of a
    larger one the last chain of lengths. Salted groups of one shingle are tied together by the shingle itself, an
    end that is no class.
    """
    dealt = rows.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "place", "node")

    def small(s: np.ndarray, node: np.ndarray, place: np.ndarray) -> np.ndarray:
        n, at, xs, ys = place >> 32, place & 0xFFFFFFFF, [], []
        for k in range(1, SMALL):
            same = s[k:] == s[:-k]
            if not same.any():
                break
            # common shingles are at most this one and those after it, at the first that a pair has in common
            most = np.minimum(n[:-k] - at[:-k], n[k:] - at[k:])
            near = np.flatnonzero(same & (5 * n[:-k] >= 4 * n[k:]) & (9 * most >= 4 * (n[:-k] + n[k:])))
            xs.append(near), ys.append(near + k)
        return _stars(np.concatenate(xs), np.concatenate(ys), node) if xs else np.empty((0, 2), np.int64)

    def chains(group: np.ndarray, s: np.ndarray, salt: np.ndarray, node: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Stars of runs of rows in which each length allows a link with the next; the last run's centre and length."""
        n = place >> 32
        breaks = np.ones(len(n), bool)
        breaks[1:] = (group[1:] != group[:-1]) | (5 * n[:-1] < 4 * n[1:])
        starts = np.flatnonzero(breaks)
        centres = np.minimum.reduceat(node, starts)
        each = np.repeat(centres, np.diff(np.append(starts, len(n))))
        ties = salt[starts] > 0
        edges = np.concatenate((np.stack((each, node), 1), np.stack((s[starts][ties], centres[ties]), 1)))
        return edges[edges[:, 0] != edges[:, 1]], (centres[-1], place[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        long_: tuple | None = None  # (shingle, salt) of a group that is known to be large

        def edges_of(cols: list[np.ndarray], cut: int) -> tuple[np.ndarray, tuple | None]:
            """Edges of the first ``cut`` rows, all of their groups ended but for the last one's."""
            s, salt, node, place = (c[:cut] for c in cols)
            group = np.concatenate(([0], np.cumsum((s[1:] != s[:-1]) | (salt[1:] != salt[:-1]))))
            size = np.bincount(group)[group]
            large = (size > SMALL) | (salt > 0)
            if long_ is not None:
                large |= (s == long_[0]) & (salt == long_[1])
            few = (size > 1) & ~large
            found, last = [small(s[few], node[few], place[few])], None
            if large.any():
                more, last = chains(group[large], s[large], salt[large], node[large], place[large])
                found.append(more)
            return np.unique(np.concatenate(found), axis=0), last

        def out(e: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, k])) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            new = np.ones(len(cols[0]), bool)  # tasks that saw copies of one class give the same rows
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            cols = [c[new] for c in cols]
            end = (cols[0][-1], cols[1][-1])
            cut = int(np.searchsorted(cols[0], end[0]))
            cut += int(np.searchsorted(cols[1][cut:], end[1]))
            if len(cols[0]) - cut > SMALL or end == long_:
                long_ = end
                e, (centre, place) = edges_of(cols, len(cols[0]))
                held = [np.array([v], np.int64) for v in (*end, centre, place)]
            else:
                e, _ = edges_of(cols, cut) if cut else (np.empty((0, 2), np.int64), None)
                held = [c[cut:] for c in cols]
            yield out(e)
        if held is not None:
            yield out(edges_of(held, len(held[0]))[0])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each end of an edge (a, b): the smallest node that it can reach.

    Each round takes minima over the neighbours, then over the label's own label. Rounds are written to
    the shared folder. Minima are combined before they are dealt, and ends with over 1/500 of the edges are salted.
    """
    kind = edges.schema["a"].dataType
    both = materialise(edges.select("a", F.col("b").alias("node")).union(edges.select(F.col("b").alias("a"), F.col("a").alias("node"))), "edges")
    heavy = heavy_keys(both.groupBy("node").count(), "node", "count")
    labels = materialise(both.groupBy("a").agg(F.min("node").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        heard = salted_join(both, labels, "node", heavy).select("a", "label", F.lit(None).cast(kind).alias("was"))
        own = labels.select(F.col("node").alias("a"), "label", F.col("label").alias("was"))
        near = heard.union(own).groupBy("a").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        near = materialise(near.select(F.col("a").alias("node"), "label", "was"), "near")
        if not near.where("label <> was").limit(1).count():
            return near.select("node", "label")
        up = near.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = materialise(near.join(up, "label", "left").select("node", F.least("label", "up").alias("label")), "labels")


def linked(i, na, nb):
    """100 * intersection >= 80 * union, in whole numbers."""
    return 100 * i >= 80 * (na + nb - i)


def solve(nodes: list, sets: list[np.ndarray], guest: np.ndarray | None = None) -> list[tuple]:
    """Links of a task, a pivot at a time, unsettled parts only: (smallest of its part, node) for each node.

    With ``guest`` the others are one part already, and only links between guests and them are looked for.
    """
    m = len(nodes)
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, codes, df = np.unique(flat, return_inverse=True, return_counts=True)
    bounds = np.concatenate(([0], np.cumsum(n)[:-1]))
    part = np.arange(m)
    if guest is not None and not guest.all():
        part[~guest] = int(np.flatnonzero(~guest)[0])
    settled = np.zeros(m, bool)
    central = np.add.reduceat(df[codes], bounds) / n
    order = np.argsort(-central, kind="stable")
    pivots: list[np.ndarray] = []
    mark = np.zeros(len(df), np.int32)
    turn = 0
    while True:
        if turn < 2:  # the most central members first: their links join most of a cluster
            open_ = order[~settled[order]]
            if not len(open_):
                break
            x = open_[0]
        else:  # then parts other than the largest, and of them only what a pivot can't rule out
            sizes = np.bincount(part[~settled], minlength=m)
            if not sizes.any():
                break
            main = int(sizes.argmax())
            open_ = order[~settled[order] & (part[order] != main)]
            if not len(open_):
                break
            x = open_[0]
        turn += 1
        rest = ~settled & (part != part[x])
        if guest is not None:
            rest &= guest != guest[x]
        if turn > 2 and rest.any():
            near = np.ones(m, bool)
            for d in pivots[:16]:
                near &= np.abs(d - d[x]) <= 0.2 + 1e-9
            rest &= near
        settled[x] = True
        if not rest.any():
            continue
        mine = codes[bounds[x] : bounds[x] + n[x]]
        mark[mine] = 1
        inter = np.add.reduceat(mark[codes], bounds).astype(np.int64)
        mark[mine] = 0
        if len(pivots) < 16:
            pivots.append(1 - inter / (n + n[x] - inter))
        for y in np.flatnonzero(linked(inter, n, n[x]) & (part != part[x]) & (rest if guest is not None else True)):
            if part[y] != part[x]:
                part[part == part[y]] = part[x]
    least: dict = {}
    for p, node in zip(part.tolist(), nodes):
        least[p] = min(node, least.get(p, node))
    return [(least[p], node) for p, node in zip(part.tolist(), nodes) if node != least[p]]


_LINKS = "a binary, b binary"


def _solve_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task: (task, side, key, s); side 0 is one part already, 1 its guests, 2 a task without sides."""
    task, keys, sides, sets = None, [], [], []

    def flush() -> pa.RecordBatch:
        guest = np.array(sides) == 1
        found = solve(keys, sets, guest if 0 in sides else None) if len(keys) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for t, side, key, s in zip(*(batch.column(i) for i in range(4))):
            t, key = t.as_py(), key.as_py()
            if t != task:
                if keys:
                    yield flush()
                task, keys, sides, sets = t, [], [], []
            if not keys or keys[-1] != key:
                keys.append(key), sides.append(side.as_py())
                sets.append(s.values.to_numpy())
    if keys:
        yield flush()


def _partitions(shingles: int, each: int) -> int:
    """An explicit number of partitions: adaptive execution would merge them by bytes, not by work."""
    return int(min(20_000, max(1, -(-shingles // each))))


def central(sets: list[np.ndarray], most: int) -> list[int]:
    """At most ``most`` places: again and again the set within 0.2 of most that none is near to yet, of equals the most alike to all."""
    m = len(sets)
    known, where = np.unique(np.concatenate(sets), return_inverse=True)
    bits = np.zeros(len(known), np.uint64)
    np.bitwise_or.at(bits, where, np.repeat(np.uint64(1) << np.arange(m, dtype=np.uint64), [len(x) for x in sets]))
    common = np.zeros((m, m), np.int64)
    for i in range(m):
        mine = bits[(bits >> np.uint64(i)) & np.uint64(1) == 1]
        common[i] = [int(((mine >> np.uint64(j)) & np.uint64(1)).sum()) for j in range(m)]
    n = np.array([len(x) for x in sets], np.int64)
    alike = (common / (n[:, None] + n[None, :] - common)).mean(1)
    near = linked(common, n[:, None], n[None, :])
    open_, out = np.ones(m, bool), []
    while len(out) < min(m, most):
        gain = (near & open_[None, :]).sum(1) + alike
        gain[out] = -1
        best = int(gain.argmax())
        out.append(best)
        open_ &= ~near[best]
    return out


def choose_pivots(work: DataFrame, turn: int) -> DataFrame:
    """(task, key): the most central of SAMPLE members of each task that the hash picks; no more of a task than these meet."""
    most = PIVOTS
    slot = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(SAMPLE)).cast("int")
    some = work.groupBy("task", slot.alias("slot")).agg(F.min_by("key", F.xxhash64("key", F.lit(turn + 1000))).alias("key")).select("task", "key")
    rows = work.join(some, ["task", "key"]).select("task", "key", "s").repartition("task").sortWithinPartitions("task", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(i) for i in range(3)))

        for task, group in groupby(each(), key=lambda r: r[0].as_py()):
            sets = {r[1].as_py(): r[2].values.to_numpy() for r in group}
            keys = list(sets)
            best = [keys[i] for i in central(list(sets.values()), most)]
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(best), pa.int64()), pa.array(best, pa.binary())], ["task", "key"])

    return materialise(rows.mapInArrow(run, "task long, key binary"), "chosen")


def meet_pivots(work: DataFrame, sums: DataFrame, turn: int) -> DataFrame:
    """Members of large tasks (task, key, n, s) against the pivots of their task.

    ``sums``: task, total (shingles). Kind 1: (task, key, n, own, other, near): the nearest pivot within 0.2 as a
    place and a key, and the places of those beyond it within 0.4. Kind 2: (task, key, other, own, near): two
    pivots that members connect.
    """
    chosen = choose_pivots(work, turn)
    wide = sums.select("task", F.ceil(F.col("total") / SHARE).cast("int").alias("salts"))
    pivots = work.join(chosen, ["task", "key"]).join(wide, "task").select("task", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "key", "n", "s")
    heavy = heavy_keys(sums, "task", "total")
    members = salted_join(work, wide, "task", heavy).select("task", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "key", "n", "s")
    n = _partitions(sums.agg(F.sum("total")).first()[0] or 0, 2 * SHARE)
    dealt = pivots.union(members).repartition(n, "task", "salt").sortWithinPartitions("task", "salt", "kind", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets = None, [], []
        table: tuple | None = None
        joined = np.zeros((PIVOTS, PIVOTS), bool)

        def connected(task: int) -> Iterator[pa.RecordBatch]:
            left, pairs = list(range(len(names))), []
            for i in range(len(names)):
                for j in range(i):
                    if joined[i, j] and left[i] != left[j]:
                        left = [left[j] if x == left[i] else x for x in left]
                        pairs.append((j, i))
            if pairs:
                m = len(pairs)
                a, b = zip(*pairs)
                yield batch_of([2] * m, [task] * m, [names[i] for i in a], [0] * m, a, [names[i] for i in b], [[i] for i in b])

        for batch in batches:
            task, salt, kind, n = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            new = np.flatnonzero(np.concatenate(([True], (task[1:] != task[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1]))))
            for i, j in zip(new, np.append(new[1:], len(task))):
                if (task[i], salt[i]) != now:
                    if now is not None:
                        yield from connected(now[0])
                    now, names, sets, table = (task[i], salt[i]), [], [], None
                    joined[:] = False
                keys, s = batch.column(3).slice(i, j - i).to_pylist(), batch.column(5).slice(i, j - i)
                if kind[i] == 0:
                    for key, x in zip(keys, s):
                        if key not in names:
                            names.append(key), sets.append(x.values.to_numpy())
                    continue
                if table is None:
                    known, where = np.unique(np.concatenate(sets), return_inverse=True)
                    bits = np.zeros(len(known), np.uint64)
                    np.bitwise_or.at(bits, where, np.repeat(np.uint64(1) << np.arange(len(sets), dtype=np.uint64), [len(x) for x in sets]))
                    table = known, bits, np.array([len(x) for x in sets], np.int64)
                known, bits, sizes = table
                flat, size = s.flatten().to_numpy(), n[i:j]
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                mask = np.where(known[at] == flat, bits[at], np.uint64(0))
                first = np.concatenate(([0], np.cumsum(size)[:-1]))
                common = np.stack([np.add.reduceat(((mask >> np.uint64(k)) & np.uint64(1)).astype(np.int64), first) for k in range(len(sets))])
                every = size[None, :] + sizes[:, None] - common
                close, window = linked(common, size[None, :], sizes[:, None]), 10 * common >= 6 * every
                own = np.where(close.any(0), np.where(close, common / every, -1.0).argmax(0), -1)
                c = close.astype(np.int32)
                joined[: len(sets), : len(sets)] |= (c @ c.T) > 0
                window &= ~close
                yield batch_of([1] * (j - i), task[i:j], keys, size, own, [names[k] if k >= 0 else None for k in own.tolist()], [np.flatnonzero(w) for w in window.T])
        if now is not None:
            yield from connected(now[0])

    def batch_of(*cols) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["kind", "task", "key", "n", "own", "other", "near"])

    return dealt.mapInArrow(run, "kind int, task long, key binary, n long, own int, other binary, near array<int>")


@F.arrow_udf(ArrayType(IntegerType()))
def _parts(pairs: pa.Array) -> pa.Array:
    """Part of each pivot, from the pairs that members connect."""
    out = []
    for p in pairs.to_pylist():
        part = list(range(PIVOTS))
        for x in p or ():
            a, b = sorted((part[x["own"]], part[x["other"]]))
            part = [a if q == b else q for q in part]
        out.append(part)
    return pa.array(out, pa.list_(pa.int32()))


def tiles(cells: DataFrame) -> DataFrame:
    """(task, side, key) of cells (cell, side, key, n): hosts (0) and guests (1) meet whole or, beyond SHARE, in blocks."""
    side = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("n"))), F.lit(0))
    held = materialise(cells.groupBy("cell").agg(side(0).alias("v"), side(1).alias("f")).where("v > 0 and f > 0"), "held")
    blocks = lambda c: F.when(F.col("v") + F.col("f") <= SHARE, 1).otherwise(F.ceil(F.col(c) * 2 / SHARE)).cast("int").alias(f"b{c}")
    heavy = heavy_keys(held.select("cell", (F.col("v") + F.col("f")).alias("all")), "cell", "all")
    met = salted_join(cells, held.select("cell", blocks("v"), blocks("f")), "cell", heavy).where("bv is not null")
    host = F.col("side") == 0
    mine = F.pmod(F.xxhash64("key", F.lit(11)), F.when(host, F.col("bv")).otherwise(F.col("bf")))
    every = F.explode(F.sequence(F.lit(0), F.when(host, F.col("bf")).otherwise(F.col("bv")) - 1))
    met = met.select("cell", "side", "key", mine.cast("int").alias("mine"), every.alias("other"))
    host = F.col("side") == 0
    task = F.xxhash64("cell", F.when(host, F.col("mine")).otherwise(F.col("other")), F.when(host, F.col("other")).otherwise(F.col("mine")))
    return met.select(task.alias("task"), "side", "key")


def blocks_of(work: DataFrame) -> DataFrame:
    """(task, side, key): members (task, key, n, s) of regions that pivots don't part, in blocks of which each pair meets.

    The whole region or, where that means fewer pairs of shingles, the groups that share one of their first
    shingles in hash order: of a linked pair at least one is common.
    """
    take = (F.col("n") - F.ceil(F.col("n") * 0.8 - 1e-9) + 1).cast("int")
    rows = work.select("task", "key", "n", F.explode(F.slice("s", F.lit(1), take)).alias("shingle")).select("task", F.xxhash64("task", "shingle").alias("cell"), "key", "n")
    held = rows.groupBy("task", "cell").agg(F.sum("n").alias("total"), F.count("*").alias("m")).where("m > 1")
    held = materialise(held, "groups")
    square = F.col("total").cast("double") * F.col("total")
    apart = held.groupBy("task").agg(F.sum(square).alias("parted"))
    whole = work.groupBy("task").agg(F.sum("n").alias("total")).join(apart, "task", "left")
    whole = materialise(whole.select("task", "total", (F.coalesce("parted", F.lit(0.0)) < square).alias("part")), "whole")
    cells = rows.join(held.join(whole.where("part").select("task"), "task").select("cell", "total"), "cell").select("cell", "key", "total")
    cells = cells.union(work.join(whole.where("not part"), "task").select(F.col("task").alias("cell"), "key", "total"))
    met = cells.withColumn("blocks", F.ceil(F.col("total") * 2 / SHARE)).withColumn("mine", F.pmod(F.xxhash64("key", F.lit(11)), F.col("blocks")))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select(F.xxhash64("cell", F.least("mine", "with"), F.greatest("mine", "with")).alias("task"), F.lit(2).alias("side"), "key")


def links_of(docs: DataFrame, members: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) that connect what is linked, from regions (task, key, n, first), split by pivots until tasks fit.

    Sets of regions that fit go to their tasks at once and are solved first, so they are never on disk twice; only those of
    larger regions are written, as they are needed again.
    """
    sums = materialise(members.groupBy("task").agg(F.sum("n").alias("total"), F.lit(None).cast("long").alias("before")), "totals")
    fit, large = sums.where(F.col("total") <= SHARE), sums.where(F.col("total") > SHARE)
    repeated = materialise(docs.groupBy(F.col(doc_id).alias("id")).count().where("count > 1 and id is not null").select("id"), "repeated")
    made = lambda some: sets_of(docs, members.join(some.select("task"), "task").select("key", "task", "first"), repeated, doc_id, text)
    total = fit.agg(F.sum("total")).first()[0] or 0
    solved = materialise(_solved(made(fit).select("task", F.lit(2).alias("side"), "key", "s"), total), "links")
    if not large.limit(1).count():
        return solved
    work = materialise(made(large), "sets")
    links, ready = [solved], []
    own = work.select("task", "key", "n").distinct()
    sets = work
    for turn in range(ROUNDS + 1):
        parts = (F.col("before").isNull() | (8 * F.col("total") <= 7 * F.col("before"))) & F.lit(turn < ROUNDS)
        stuck = large.where(~parts).select("task")
        if stuck.limit(1).count():
            ready.append(blocks_of(sets.join(stuck, "task")))
            sets, large = sets.join(stuck, "task", "left_anti"), large.where(parts)
            if not large.limit(1).count():
                break
        met = materialise(meet_pivots(sets, large, turn), "met")
        links.append(met.where("other is not null and key <> other").select(F.col("key").alias("a"), F.col("other").alias("b")))
        pairs = met.where("kind = 2").select("task", "own", F.get("near", F.lit(0)).alias("other")).groupBy("task").agg(F.collect_set(F.struct("own", "other")).alias("pairs"))
        parted = pairs.select("task", _parts("pairs").alias("parts"))
        one = salted_join(met.where("kind = 1").select("task", "key", "n", "own", "near"), parted, "task", heavy_keys(large, "task", "total"))
        part = lambda k: F.coalesce(F.get("parts", k), k)
        foreign = F.filter("near", lambda q: (F.col("own") < 0) | (part(q) != part(F.col("own"))))
        one = materialise(one.select("task", "key", "n", "own", foreign.alias("near")), "cells")
        hosts = one.where("own >= 0").select(F.xxhash64("task", "own").alias("cell"), F.lit(0).alias("side"), "key", "n")
        guests = one.select("task", F.explode("near").alias("q"), "key", "n").select(F.xxhash64("task", "q").alias("cell"), F.lit(1).alias("side"), "key", "n")
        ready.append(tiles(hosts.union(guests)))
        rest = one.where("own < 0").select("task", "key", "n").join(large.select("task", F.col("total").alias("before")), "task")
        own = materialise(rest.select(F.xxhash64("task", F.lit(turn)).alias("task"), "key", "n", "before"), "rest")
        sums = materialise(own.groupBy("task").agg(F.sum("n").alias("total"), F.max("before").alias("before")), "totals")
        ready.append(own.join(sums.where(F.col("total") <= SHARE).select("task"), "task").select("task", F.lit(2).alias("side"), "key"))
        large = sums.where(F.col("total") > SHARE)
        if not large.limit(1).count():
            break
        sets = work.select("key", "s").join(own.join(large.select("task"), "task").select("task", "key", "n"), "key").select("task", "key", "n", "s")
        sets = materialise(sets, "large")
    dealt = ready[0]
    for more in ready[1:]:
        dealt = dealt.union(more)
    dealt = materialise(dealt, "tasks")
    total = dealt.join(work.select("key", "n"), "key").agg(F.sum("n")).first()[0] or 0
    full = dealt.join(work.select("key", "s"), "key").select("task", "side", "key", "s")
    out = _solved(full, total)
    for more in links:
        out = out.union(more)
    return materialise(out, "links")


def _solved(tasks: DataFrame, total: int) -> DataFrame:
    """Links of rows (task, side, key, s)."""
    return tasks.repartition(_partitions(total, 4 * SHARE), "task").sortWithinPartitions("task", "side", "key").mapInArrow(_solve_groups, _LINKS)


def linked_classes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n, key) of ``docs`` and, for each class, (key, first, copies, label): its smallest id and its component."""
    seen = materialise(signatures(docs, doc_id, text), "signatures")
    own = seen.where("kind = 0").select("id", "n", "key")
    classes = seen.where("kind = 0 and n > 0").groupBy("key").agg(F.min("id").alias("first"), F.max("n").alias("n"), F.max("node").alias("node"), F.count("*").alias("copies"))
    classes = materialise(classes, "classes")
    hot = frequent(seen.where("kind = 1"))
    # a class's shingles come from the document of its smallest id; marks may let copies pass, which changes nothing
    named, rest = marked(docs.select(doc_id, text), doc_id, marks(classes.select("first"), "first"))
    one = named.union(rest.where(F.col(f"`{doc_id}`").isNull()))
    met = met_twice(one, hot, classes.agg(F.sum("n")).first()[0] or 0, text)
    edges = materialise(candidates(prefixes(one, hot, text, met)), "stars")

    # ends that are shingles are no classes and fall away here
    members = materialise(components(edges).join(classes, "node").select("key", F.col("label").alias("task"), "n", "first"), "members")
    label = components(links_of(docs, members, doc_id, text)).withColumnRenamed("node", "key")
    known = classes.join(label, "key", "left").select("key", "first", "copies", F.coalesce("label", "key").alias("label"))
    return own, materialise(known, "known")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    own, known = linked_classes(docs, doc_id, text)
    lowest = materialise(known.groupBy("label").agg(F.min("first").alias("component"), F.count("*").alias("classes")), "lowest")
    named = salted_join(known, lowest.select("label", "component"), "label", heavy_keys(lowest, "label", "classes")).select("key", "component")
    out = salted_join(own, materialise(named, "named"), "key", heavy_keys(known, "key", "copies"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


@F.arrow_udf(BinaryType())
def _key(t: pa.Array) -> pa.Array:
    """Class of a text, null for an empty set."""
    return pa.array([key_of(s) if len(s) else None for s in shingle_sets(x.as_py() for x in t)], pa.binary())


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that of smallest id, with its columns as they were.

    Rows are told apart by id and set, so those that share an id only are each judged by their own component;
    of rows with the same id and set the one of least text stays. A component without any id keeps one row too.
    Rows whose id no other row has are found by it alone; only the others are hashed once more, and one row of
    each id and set is chosen by an aggregate, so no group is listed.
    """
    own, known = linked_classes(docs.select(doc_id, text), doc_id, text)
    least = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key")).alias("k")
    heads = known.groupBy("label").agg(least).select(F.col("k.first").alias("id"), "k.key")
    empty = own.where("n = 0").select("id", "key").distinct()
    kept = materialise(heads.union(empty), "kept")
    ids = materialise(own.groupBy("id").agg(F.count("*").alias("rows")), "ids")
    many = materialise(ids.where("rows > 1 and id is not null"), "repeated")
    heavy = heavy_keys(ids.where("rows > 1"), "id", "rows")
    name = lambda c: F.col(f"`{c}`")
    hot = F.coalesce(name(doc_id).isin(heavy), F.lit(False)) if heavy else F.lit(False)
    plain = kept.where("id is not null").join(many, "id", "left_anti").select(F.col("id").alias("_id"))
    # most documents stay: only rows that may go, or share an id, are dealt to be looked up
    doubtful = ids.where("id is not null").join(plain, F.col("id") == F.col("_id"), "left_anti").select("id")
    asked, sure = marked(docs, doc_id, marks(doubtful, "id"))
    first = sure.where(name(doc_id).isNotNull()).union(asked.where(~hot).join(plain.hint("merge"), name(doc_id) == F.col("_id"), "left_semi"))
    if not many.limit(1).count() and not ids.where("id is null and rows > 0").limit(1).count():
        return first
    some = docs.where(name(doc_id).isNull() | hot).union(docs.where(~hot).join(many.select(F.col("id").alias("_id")), name(doc_id) == F.col("_id"), "left_semi"))
    wanted = kept.select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    row = F.struct(*[name(c) for c in docs.columns])
    slim = some.select(name(doc_id).alias("_i"), _key(name(text).cast("binary")).alias("_k"), F.struct(name(text).alias("t"), F.xxhash64(*[name(c) for c in docs.columns]).alias("h")).alias("_o"), row.alias("_row"))
    one = slim.groupBy("_i", "_k").agg(F.min_by("_row", "_o").alias("_row"))
    on = F.col("_i").eqNullSafe(F.col("_id")) & F.col("_k").eqNullSafe(F.col("_key"))
    return first.union(one.join(wanted, on, "left_semi").select("_row.*"))


def sets_of(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(task, key, n, s) for rows (task, key, first): sets made anew from the document of smallest id.

    ``repeated`` has the ids of several rows. Documents without an id can't be joined by it; all of them are looked at and joined by class. A class may
    come more than once where ids repeat, at most once a task; that only repeats links.
    """
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("t"))
    ids = wanted.where("first is not null").select(F.col("first").alias("id"), "task", "key").hint("merge")  # as many ids as classes: dealt, at every size
    known = marked(slim, "id", marks(ids, "id"))[0]  # only these texts are dealt
    if repeated.limit(1).count():
        # of ids with several rows, which may be of many classes, each class meets its own row alone
        several = known.join(repeated, "id", "left_semi").withColumn("key", _key(F.col("t"))).where("key is not null").dropDuplicates(["id", "key"])
        some = known.join(repeated, "id", "left_anti").join(ids, "id").select("t", "task", "key").union(several.join(ids, ["id", "key"]).select("t", "task", "key"))
    else:
        some = known.join(ids, "id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in few(batches):
            tasks, keys, sets = [], [], []
            for task, want, s in zip(*(batch.column(i).to_pylist() for i in (1, 2)), shingle_sets(_texts(batch, 0))):
                if len(s):
                    key = key_of(s)
                    if (want is None or want == key) and key not in seen:
                        if len(seen) < 500_000:
                            seen.add(key)
                        tasks.append(task), keys.append(key), sets.append(s)
            sizes = [len(s) for s in sets]
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists], ["task", "key", "n", "s"])

    kind = "task long, key binary, n long, s array<long>"
    made = some.select("t", "task", "key").mapInArrow(make, kind)
    nameless = slim.where("id is null").select("t", F.lit(None).cast("long").alias("task"), F.lit(None).cast("binary").alias("key")).mapInArrow(make, kind)
    more = nameless.drop("task").join(wanted.where("first is null").select("task", "key"), "key").select("task", "key", "n", "s")
    return made.union(more)
