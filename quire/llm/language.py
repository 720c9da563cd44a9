"""Language identification by error-correcting output codes.

Every language has a codeword of bits; one binary classifier a bit says on which side of it a text lies, and the
nearest codeword wins. Up to six languages have the exhaustive code (all 2^(L-1) - 1 ways to part them), more have
10 * log2(L) random columns, of several draws that with the largest least distance between codewords.

A bit's classifier is naive Bayes over character n-grams (one to three letters of lower-cased words, with a blank at both
ends) in BUCKETS hashed buckets: its margin is the sum of log odds over the square root of their number. Decoding is loss-weighted: a
codeword's distance is the mean logistic loss of its bits, each weighted with how often its classifier is right on that language.
Distances give probabilities; ``score`` is that of the nearest, and a text is ``ambiguous`` if the next is within AMBIGUOUS.

The classifiers learn from SAMPLE documents of each language at most (their hashes choose), in Spark; the driver gets BUCKETS times
bits sums and no document. All documents are judged, whole, in one pass without a shuffle.

Learned from: rows with a language and a letter that aren't held out (checksum of the id as text, modulo 4, is 2). A row without
an id is neither held out nor learned from. A null text or one without a letter (``\\p{L}``) is ``und`` with score 0, as is every text if
nothing was learned; ties go to the language that sorts first. Equal rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import materialise

SAMPLE = 5_000  # documents a language
LANGUAGES = 10_000  # more labels than that aren't languages
BUCKETS = 1 << 16
LONGEST = 3
CHUNK = 1 << 18  # characters
AMBIGUOUS = 0.2
UNDETERMINED = "und"
EXHAUSTIVE = 6

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def codewords(languages: int) -> np.ndarray:
    """A row of bits (1 or -1) per language; no column is constant, equal to another or its reverse."""
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= EXHAUSTIVE:
        columns = [c for c in itertools.product((1, -1), repeat=languages) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    width, best = math.ceil(10 * math.log2(languages)), None
    for draw in range(10):
        columns, n = {}, 0
        while len(columns) < width:
            n += 1
            bits = np.unpackbits(np.frombuffer(hashlib.shake_128(f"{draw} {n}".encode()).digest(languages // 8 + 1), np.uint8))[:languages]
            if 0 < bits.sum() < languages:
                columns.setdefault((bits ^ bits[0]).tobytes(), bits)
        code = np.array(list(columns.values()), np.int8).T * 2 - 1
        agree = code.astype(np.float32) @ code.T.astype(np.float32)
        least = (width - np.max(agree - 2 * width * np.eye(languages))) / 2
        if best is None or least > best[0]:
            best = (least, code)
    return best[1]


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text's words, in chunks."""
    for a in range(0, len(text), CHUNK):
        letters = f" {_NOT_LETTERS.sub(' ', text[a : a + CHUNK].lower()).strip()} "
        c = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        found, h = [], np.zeros(len(c), np.uint64)
        for n in range(1, LONGEST + 1):
            # h: hashes of n characters from each place
            h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            found.append(h[c[: len(h)] != 32] if n == 1 else h)
        yield (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64)


def _few(batches: Iterator[pa.RecordBatch], most: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of a few documents, as all of one as strings may be many times what is wanted in memory."""
    return (b.slice(at, most) for b in batches for at in range(0, b.num_rows, most))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # language, bit
    odds: np.ndarray  # bucket, bit
    weights: np.ndarray  # language, bit; rows sum to the number of bits

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for g in grams(text):
            total += self.odds[g].sum(axis=0)
            n += len(g)
        return total / math.sqrt(max(1, n))

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """Of each language, from the loss-weighted distance to its codeword."""
        loss = (self.weights * np.logaddexp(0, -self.code * margins)).sum(axis=1)
        p = np.exp(loss.min() - loss)
        return p / p.sum()


def _held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def sample(documents: DataFrame, id_: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> DataFrame:
    """(lang, text) of up to ``most`` labelled documents of each language that aren't held out."""
    rows = documents.select(F.col(id_).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~_held_out(F.col("id")))
    sizes = rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} different languages")
    if not sizes:
        return rows.select("lang", "text").limit(0)
    # the hash leaves some more than is wanted, of which the least are taken
    h = F.xxhash64("id", "text")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.3 * most / r["count"]))])
    near = rows.where(_has_letter(F.col("text"))).withColumn("_h", h).where(F.pmod("_h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 20)), "_h", "id")))
    return ranked.where(F.col("_k") <= most).select("lang", "text")


def fit(documents: DataFrame, id_: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> Model:
    spark = documents.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows = materialise(sample(documents, id_, text, lang, most).repartition(cores), "labelled")
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    code = codewords(len(languages))
    bits, place = code.shape[1], {l: i for i, l in enumerate(languages)}
    if not bits:
        return Model(languages, code, np.zeros((BUCKETS, 0), np.float32), np.ones(code.shape))

    def counted(batches):
        """Occurrences of each bucket on the positive side of every bit, and in all."""
        seen = np.zeros((BUCKETS, bits + 1), np.int64)
        for b in _few(batches):
            for l, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                side = np.append(code[place[l]] > 0, True).astype(np.int64)
                for g in grams(t):
                    found, n = np.unique(g, return_counts=True)
                    seen[found] += n[:, None] * side
        some = np.flatnonzero(seen[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(seen[some, k]) for k in range(bits + 1)]], names=["bucket", *[f"n{k}" for k in range(bits + 1)]])

    names = [f"n{k}" for k in range(bits + 1)]
    sums = rows.mapInArrow(counted, "bucket long, " + ", ".join(f"{n} long" for n in names))
    table = sums.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    count = np.zeros((BUCKETS, bits + 1))
    count[table["bucket"].to_numpy()] = np.column_stack([table[n].to_numpy() for n in names])
    yes, no = count[:, :-1] + 0.5, count[:, -1:] - count[:, :-1] + 0.5
    odds = (np.log(yes / yes.sum(axis=0)) - np.log(no / no.sum(axis=0))).astype(np.float32)
    odds[count[:, -1] == 0] = 0  # what was never seen tells nothing
    first = Model(languages, code, odds, np.ones(code.shape))

    def right(batches):
        """How often each bit is right on each language."""
        for b in _few(batches):
            langs = b.column("lang").to_pylist()
            hits = [(first.code[place[l]] * first.margins(t) > 0).astype(int).tolist() for l, t in zip(langs, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(hits, pa.list_(pa.int64()))], names=["lang", "hits"])

    rates = rows.mapInArrow(right, "lang string, hits array<long>").groupBy("lang").agg(*[F.avg(F.get("hits", F.lit(k))).alias(f"n{k}") for k in range(bits)]).collect()
    weights = np.full(code.shape, 1e-3)
    for r in rates:
        weights[place[r["lang"]]] = np.maximum(1e-3, [r[f"n{k}"] for k in range(bits)])
    return Model(languages, code, odds, weights * bits / weights.sum(axis=1, keepdims=True))


def identify(documents: DataFrame, model: Model, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous, runner_up) of every document; only its text is judged."""

    def judged(batches):
        for b in _few(batches):
            out = []
            for t in b.column("text").to_pylist():
                if t is None or not model.languages:
                    out.append((UNDETERMINED, 0.0, False, None))
                    continue
                p = model.probabilities(model.margins(t))
                order = np.argsort(-p, kind="stable")[:2]
                next_ = p[order[1]] if len(order) > 1 else 0.0
                out.append((model.languages[order[0]], float(p[order[0]]), bool(p[order[0]] - next_ < AMBIGUOUS), model.languages[order[1]] if len(order) > 1 else None))
            cols = [pa.array(x, k) for x, k in zip(zip(*out), (pa.string(), pa.float64(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), *cols], names=["id", "held_out", "lang_pred", "score", "ambiguous", "runner_up"])

    rows = documents.select(F.col(id_).alias("id"), _held_out(F.col(id_)).alias("held_out"), F.when(_has_letter(F.col(text)), F.col(text)).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(judged, f"id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean, runner_up string").withColumnRenamed("id", id_)
