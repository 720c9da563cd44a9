"""Phrase collocation mining: frequent phrases of two to five words by position bitmaps, scored by their weakest cut.

A-Z are lower-cased; texts split at ``.,;:!?`` and line ends into pieces and those at blanks and tabs into words. The words of
a language (null: ``und``) that a task has read make shards of about SHARD positions, with a gap after every piece. In a shard each word has a
bitmap of its positions, kept as its words of 64 bits that aren't zero. A phrase's bitmap has the positions of its last
words: shifted by one and met with a word's bitmap (AND) it is that of the longer phrase, and its number of bits, summed
over shards, is how often the phrase occurs. Only the sums tell which phrases are frequent, so all shards extend by one word
and then wait for them; a shard goes on below the frequent phrases alone, and only where the phrase without its
first word is frequent too. In a shard, the block's own words say which bitmaps a phrase's block needs to meet.

Bitmaps of the phrases of one length have no position in common, so they are written as a number per position, without
positions where nothing frequent ends, and compressed. Counts go to their sums in compressed columns too: those of a shard and a
bucket of phrases in one row, with so many buckets that all rows of one fit a task.

Null and empty texts have no words. Equal rows count each. Other columns are ignored. A word or piece may have any
length: a shard that a piece doesn't fit is longer. Counts are exact; scores are computed in whole decimals of 38 digits.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import materialise

SHARD = 1 << 21  # positions
BUCKET = 1 << 20  # words or positions of all shards for each bucket of words or phrases
CHUNK = 1 << 20  # bytes of text whose words are lists of Python at a time
LEAST, LONGEST, TOP = 100, 5, 2000
SHARDS_A_TASK = 1 << 20  # numbers of shards: task * SHARDS_A_TASK + count

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


# --- arrays


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, of numbers from -1, as compressed byte planes."""
    a = np.concatenate(arrays) + 1
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(a).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(a) else b"")


def _unpack(b: bytes) -> np.ndarray:
    """The arrays, one behind the other."""
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.empty(0, np.int64)
    planes = np.frombuffer(pa.decompress(b[8:], 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel() - 1


def _changes(a: np.ndarray) -> np.ndarray:
    """Whether each number is other than the one before."""
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return new


def _sums(a: np.ndarray, first: np.ndarray, f=np.add) -> np.ndarray:
    return f.reduceat(a, first) if len(first) else a[:0]


class Bitmaps:
    """A bitmap of positions for every number from 0 in ``ids``: blocks of 64 bits that aren't zero, by owner and block.

    ``at`` has all positions in that order and ``row`` the block of each.
    """

    def __init__(self, ids: np.ndarray) -> None:
        self.blocks = len(ids) // 64 + 2
        low = max(1, len(ids).bit_length())
        code = np.flatnonzero(ids >= 0)
        code = np.sort(ids[code] << low | code)
        self.at, owner = code & ((1 << low) - 1), code >> low
        code = owner * self.blocks + (self.at >> 6)
        new = _changes(code)
        self.row = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.code = code[first]  # owner and block
        self.bits = _sums(np.uint64(1) << (self.at & 63).astype(np.uint64), first, np.bitwise_or)

    @property
    def owner(self) -> np.ndarray:
        return self.code // self.blocks

    def popcounts(self, size: int) -> np.ndarray:
        return np.bincount(self.owner, np.bitwise_count(self.bits), size).astype(np.int64)

    def shifted(self) -> "Bitmaps":
        """All positions one on."""
        out = object.__new__(Bitmaps)
        moved, over = self.bits << np.uint64(1), self.bits >> np.uint64(63) > 0
        stay = moved > 0
        out.blocks, out.at = self.blocks, self.at + 1
        out.code = np.union1d(self.code[stay], self.code[over] + 1)
        out.bits = np.zeros(len(out.code), np.uint64)
        out.bits[np.searchsorted(out.code, self.code[stay])] = moved[stay]
        out.bits[np.searchsorted(out.code, self.code[over] + 1)] |= np.uint64(1)
        out.row = np.cumsum(_changes(self.code[self.row] // self.blocks * self.blocks + (out.at >> 6))) - 1
        return out


def extensions(phrases: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, word, count): how often a word stands right behind the end of a phrase, both given as a number per position."""
    w = Bitmaps(words)
    p = (w if phrases is words else Bitmaps(phrases)).shifted()
    # the words' blocks that a phrase's block needs to meet: those of the words at its positions
    block_of = np.full(len(words) + 1, -1)
    block_of[w.at] = w.row
    other = block_of[p.at]
    wide = max(1, len(w.bits))
    pairs = np.sort(p.row[other >= 0] * wide + other[other >= 0])
    pairs = pairs[_changes(pairs)]
    mine, other = pairs // wide, pairs % wide
    n = np.bitwise_count(p.bits[mine] & w.bits[other]).astype(np.int64)
    wide = int(words.max(initial=0)) + 1
    # at most 64 bits a block, so counts fit below the pair and sort with it
    code = np.sort((p.owner[mine] * wide + w.owner[other]) << 7 | n)
    pair, n = code >> 7, code & 127
    first = np.flatnonzero(_changes(pair))
    return pair[first] // wide, pair[first] % wide, _sums(n, first)


def _closed(keep: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    """Arrays without the positions that aren't kept, but for one of each run of those, at which all are -1."""
    stay = keep.copy()
    stay[1:] |= keep[:-1]
    return [np.where(keep, a, -1)[stay] for a in arrays]


# --- tasks


def _chunks(text: bytes) -> Iterator[bytes]:
    """Folded text in chunks that end where a piece ends."""
    at = 0
    while len(text) - at > CHUNK:
        cut = text.find(b"\n", at + CHUNK) + 1
        if not cut:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class _Shard:
    """The words of one language that a task has read, as numbers."""

    def __init__(self) -> None:
        self.vocabulary = defaultdict(itertools.count().__next__)
        self.vocabulary[b""], self.vocabulary[b"\n"]  # 0: nothing, 1: end of a piece
        self.parts, self.size, self.waiting, self.bytes = [], 0, [], 0

    def add(self, text: bytes) -> None:
        for chunk in _chunks(text.translate(_FOLD)):
            self.waiting.append(chunk)
            self.bytes += len(chunk)
            if self.bytes >= CHUNK:
                self.read()

    def read(self) -> None:
        words = b"\n".join(self.waiting).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words)) - 2
        ids = ids[ids > -2]
        ids = _closed(ids >= 0, ids)[0]
        self.parts += [ids, np.array([-1])]
        self.size += len(ids) + 1
        self.waiting, self.bytes = [], 0

    def row(self, shard: int, lang: str) -> dict:
        self.read()
        ids = np.concatenate(self.parts)
        words = list(self.vocabulary)[2:]
        return {"shard": shard, "lang": lang, "words": [w.decode() for w in words], "counts": Bitmaps(ids).popcounts(len(words)), "stream": _pack(ids)}


SHARDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("stream", pa.binary())])


def _shards(batches: Iterator[pa.RecordBatch], positions: int) -> Iterator[pa.RecordBatch]:
    open_, number, first = defaultdict(_Shard), 0, TaskContext.get().partitionId() * SHARDS_A_TASK

    def close(lang):
        nonlocal number
        if number == SHARDS_A_TASK:
            raise ValueError("a task has read more shards than there are numbers; give the input more partitions")
        row = open_.pop(lang).row(first + number, lang)
        number += 1
        return pa.RecordBatch.from_pylist([row], schema=SHARDS)

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            open_[lang].add(text.as_buffer().to_pybytes())
            if sum(s.size for s in open_.values()) >= positions:
                yield close(max(open_, key=lambda k: open_[k].size))
    for lang in list(open_):
        yield close(lang)


WORDS = pa.schema([("shard", pa.int64()), ("known", pa.binary()), ("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])
WORDS_DDL = "shard long, known binary, id long, lang string, word string, f long"


def _spelt(batches, buckets: int):
    """A shard's words with their counts, those of a bucket in one row, in order."""
    for b in batches:
        for shard, lang, words, counts in zip(b.column("shard").to_pylist(), b.column("lang").to_pylist(), b.column("words"), b.column("counts")):
            words, n = [w.encode() for w in words.as_py()], counts.values.to_numpy()
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            order = order[np.argsort(bucket[order], kind="stable")]
            first = np.flatnonzero(_changes(bucket[order]))
            rows = [(int(bucket[i[0]]), shard, lang, zlib.compress(b"\n".join(words[k] for k in i), 6), _pack(i, n[i])) for i in np.split(order, first[1:]) if len(i)]
            cols = zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in cols], names=["bucket", "shard", "lang", "words", "counts"])


def _buckets(batches) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket; they lie together."""
    at, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["bucket"] != at and rows:
                yield at, rows
                rows = []
            at = r["bucket"]
            rows.append(r)
    if rows:
        yield at, rows


def _known(batches, least: int, buckets: int):
    """Sums of a bucket's words over shards: rows (id, lang, word, f) of frequent words, and for each shard which of its own are."""
    for bucket, rows in _buckets(batches):
        made = 0
        for lang in sorted({r["lang"] for r in rows}):
            mine = [r for r in rows if r["lang"] == lang]
            words = pa.array([w for r in mine for w in zlib.decompress(r["words"]).split(b"\n")], pa.binary()).dictionary_encode()
            own, n = np.concatenate([_unpack(r["counts"]).reshape(2, -1) for r in mine], axis=1)
            codes = words.indices.to_numpy()
            f = np.bincount(codes, n).astype(np.int64)
            many = np.flatnonzero(f >= least)
            numbers = np.full(len(f), -1)
            numbers[many] = (np.arange(len(many)) + made) * buckets + bucket
            made += len(many)
            none = pa.nulls(len(many), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(len(many), pa.binary()), pa.array(numbers[many]), pa.array([lang] * len(many), pa.string()), words.dictionary.take(pa.array(many)).cast(pa.string()), pa.array(f[many])], schema=WORDS)
            ends = np.cumsum([len(_unpack(r["counts"])) // 2 for r in mine])
            numbers = numbers[codes]
            lists = []
            for r, i, k in zip(mine, np.split(own, ends[:-1]), np.split(numbers, ends[:-1])):
                if (k >= 0).any():
                    lists.append((r["shard"], _pack(i[k >= 0], k[k >= 0])))
            none = pa.nulls(len(lists), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in lists], pa.int64()), pa.array([x for _, x in lists], pa.binary()), none, none.cast(pa.string()), none.cast(pa.string()), none], schema=WORDS)


STATE = pa.schema([("shard", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("words", pa.binary()), ("phrases", pa.binary())])
STATE_DDL = "shard long, size long, ids binary, ends binary, words binary, phrases binary"
SUMS = pa.schema([("shard", pa.int64()), ("known", pa.binary()), ("id", pa.int64()), ("prefix", pa.int64()), ("word", pa.int64()), ("f", pa.int64())])
SUMS_DDL = "shard long, known binary, id long, prefix long, word long, f long"


def _state(shard: int, ids: np.ndarray, ends: np.ndarray | None, words: np.ndarray, phrases: np.ndarray) -> pa.RecordBatch:
    """A shard: words and ends of phrases by position, numbered in it by the order of their numbers in all shards.

    Ends of phrases of one word are the words.
    """
    row = {"shard": shard, "size": len(ids), "ids": _pack(ids), "ends": None if ends is None else _pack(ends), "words": _pack(words), "phrases": None if ends is None else _pack(phrases)}
    return pa.RecordBatch.from_pylist([row], schema=STATE)


def _first_state(batches):
    """Shards with their frequent words only."""
    for b in batches:
        for r in b.to_pylist():
            own, numbers = np.concatenate([_unpack(k).reshape(2, -1) for k in r["known"]], axis=1)
            stream = _unpack(r["stream"])
            new = np.full(int(stream.max(initial=0)) + 2, -1)
            new[own[np.argsort(numbers)]] = np.arange(len(numbers))
            ids = new[stream]
            yield _state(r["shard"], _closed(ids >= 0, ids)[0], None, np.sort(numbers), None)


def _next_state(batches):
    """Shards whose frequent phrases are a word longer: those that the sums over all shards left."""
    for b in batches:
        for r in b.to_pylist():
            ids, words = _unpack(r["ids"]), _unpack(r["words"])
            ends, phrases = (ids, words) if r["ends"] is None else (_unpack(r["ends"]), _unpack(r["phrases"]))
            prefix, word, numbers = np.concatenate([_unpack(k).reshape(3, -1) for k in r["known"]], axis=1)
            codes = np.searchsorted(phrases, prefix) * len(words) + np.searchsorted(words, word)
            order = np.argsort(codes)
            codes, numbers = codes[order], numbers[order]
            place = np.empty(len(numbers), np.int64)
            place[np.argsort(numbers)] = np.arange(len(numbers))
            pair = np.where((ends[:-1] >= 0) & (ids[1:] >= 0), ends[:-1] * len(words) + ids[1:], -1)
            at = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
            longer = np.concatenate([[-1], np.where(codes[at] == pair, place[at], -1)])
            # the phrase without its first word must be frequent too, so only where one ends can one more word stand
            ids, longer = _closed(longer >= 0, ids, longer)
            yield _state(r["shard"], ids, longer, words, np.sort(numbers))


def _extended(batches, buckets: int):
    """A shard's longer phrases with their counts, those of a bucket in one row: a bucket meets that of all other shards."""
    for b in batches:
        for r in b.to_pylist():
            ids, words = _unpack(r["ids"]), _unpack(r["words"])
            ends, phrases = (ids, words) if r["ends"] is None else (_unpack(r["ends"]), _unpack(r["phrases"]))
            p, w, n = extensions(ends, ids)
            prefix, word = phrases[p], words[w]
            mixed = prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)
            bucket = ((mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            low = len(p).bit_length()
            order = np.sort(bucket << low | np.arange(len(p)))
            bucket, order = order >> low, order & ((1 << low) - 1)
            first = np.flatnonzero(_changes(bucket))
            rows = [_pack(np.diff(prefix[i], prepend=0), word[i], n[i]) for i in np.split(order, first[1:])] if len(p) else []
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(np.full(len(first), r["shard"])), pa.array(rows, pa.binary())], names=["bucket", "shard", "counts"])


def _summed(batches, least: int, buckets: int):
    """Sums of each bucket over shards: rows (id, prefix, word, f) of frequent phrases, and for each shard which of its own are."""

    for bucket, rows in _buckets(batches):
        parts = [_unpack(r["counts"]).reshape(3, -1) for r in rows]
        prefix, word, n = np.concatenate([np.stack([np.cumsum(x[0]), x[1], x[2]]) for x in parts], axis=1)
        of = np.repeat(np.arange(len(parts)), [x.shape[1] for x in parts])
        wide = int(word.max()) + 1
        if int(prefix.max()) < (1 << 62) // wide:
            code = prefix * wide + word
        else:
            code = np.unique(prefix, return_inverse=True)[1] * wide + word
        order = np.argsort(code)
        first = np.flatnonzero(_changes(code[order]))
        f = np.add.reduceat(n[order], first)
        many = f >= least
        numbers = np.full(len(f), -1)
        numbers[many] = np.arange(many.sum()) * buckets + bucket
        of_pair = np.empty(len(code), np.int64)
        of_pair[order] = np.repeat(numbers, np.diff(np.append(first, len(code))))
        at = order[first[many]]
        k = len(at)
        none = pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(k, pa.binary()), pa.array(numbers[many]), pa.array(prefix[at]), pa.array(word[at]), pa.array(f[many])], schema=SUMS)
        own = np.flatnonzero(of_pair >= 0)
        lists = [(r["shard"], _pack(prefix[i], word[i], of_pair[i])) for r, i in zip(rows, np.split(own, np.searchsorted(of[own], np.arange(1, len(parts))))) if len(i)]
        none = pa.nulls(len(lists), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in lists], pa.int64()), pa.array([x for _, x in lists], pa.binary()), none, none, none, none], schema=SUMS)


# --- jobs


def shards(documents: DataFrame, text: str = "text", lang: str = "lang", positions: int = SHARD) -> DataFrame:
    """A row per shard: its words with their popcounts and its positions."""
    slim = documents.where(F.col(text) != "").select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return materialise(slim.mapInArrow(partial(_shards, positions=positions), "shard long, lang string, words array<string>, counts array<long>, stream binary"), "shards")


def _dealt(counts: DataFrame, buckets: int, tasks: int, sums, ddl: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """Buckets summed, each in one task: what is frequent, and (shard, known) with the lists of each shard."""
    out = materialise(counts.repartition(min(buckets, tasks), "bucket").sortWithinPartitions("bucket").mapInArrow(sums, ddl), tag)
    return out.where("id IS NOT NULL").drop("shard", "known"), out.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list("known").alias("known"))


def mine(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, positions: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """All frequent phrases up to ``longest`` words: (lang, words, f), and the number of words of each language: (lang, n)."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    first = shards(documents, text, lang, positions)
    # compressed bytes tell little of the work, so numbers of tasks are given
    tasks = max(cores, first.count() // 2 + 1)
    totals = first.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n"))
    buckets = max(cores, (first.agg(F.sum(F.size("words"))).first()[0] or 0) // BUCKET + 1)
    spelt = first.select("shard", "lang", "words", "counts").mapInArrow(partial(_spelt, buckets=buckets), "bucket long, shard long, lang string, words binary, counts binary")
    single, known = _dealt(spelt, buckets, 8 * tasks, partial(_known, least=least, buckets=buckets), WORDS_DDL, "words")
    level = single.select("lang", "id", F.array("word").alias("words"), "f")
    spelt = single.select(F.col("id").alias("word"), F.col("word").alias("spelt"))
    levels, state, step = [level], first.select("shard", "stream"), _first_state
    for _ in range(longest - 1):
        met = state.repartition(tasks, "shard").join(known.repartition(tasks, "shard"), "shard")
        state = materialise(met.mapInArrow(step, STATE_DDL), "state")
        buckets = max(cores, (state.agg(F.sum("size")).first()[0] or 0) // BUCKET + 1)
        counts = state.mapInArrow(partial(_extended, buckets=buckets), "bucket long, shard long, counts binary")
        new, known = _dealt(counts, buckets, 8 * tasks, partial(_summed, least=least, buckets=buckets), SUMS_DDL, "sums")
        new = new.join(level.select(F.col("id").alias("prefix"), "lang", "words"), "prefix").join(spelt, "word")
        level = materialise(new.select("lang", "id", F.array_append("words", F.col("spelt")).alias("words"), "f"), "level")
        levels.append(level)
        step = _next_state
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("lang", "words", "f"), totals


def score(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more that no longer one stands for.

    A phrase falls to a longer one around it that is as frequent; as frequency can only fall with length, one of a word
    more is then as frequent as well, so those alone are looked at.
    """
    spelt = phrases.select("lang", F.array_join("words", " ").alias("phrase"), "f")
    many = phrases.where(F.size("words") > 1).withColumnRenamed("f", "a")
    size = F.size("words")
    around = many.where(size > 2).select("lang", "a", F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("part"))
    around = around.groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    named = many.withColumn("phrase", F.array_join("words", " "))
    stay = named.join(around, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    cuts = stay.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right"))
    cuts = cuts.join(spelt.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(spelt.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    # 16 digits are enough for any count of words, so products are whole and exact
    value = F.expr("CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0)) * 1000BD div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))")
    worst = cuts.withColumn("score", value).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return worst.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def top(scored: DataFrame, most: int = TOP) -> DataFrame:
    """The first ``most`` phrases of each language: of parts of a language first, so that none is ranked in one task whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = scored.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("_rank") <= most)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.drop("_rank")
