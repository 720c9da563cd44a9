"""Exact nearest vectors by an index over chords: cells around centres, cut into pages of like distance (JN-13, JN-14).

On unit vectors the chord is a metric and falls as cosine grows. Every term lies in the cell of its nearest centre; the
terms of a cell, sorted by their distance to it, are cut into pages of at most PAGE terms, which know the least and the
largest distance. By the triangle inequality a page can hold a query's neighbour at distance t only if the query's
distance to the centre is within t of that window, and a cell only if its centre is within 2 t of being the query's nearest.
t starts at the k-th distance to a bounded sample of terms that pass the query's filter, and shrinks as pages are read.

Where vectors have clusters, most pages are never compared; where they are spread evenly over many dimensions no bound
separates them, and every page is. The result is the same: the exact top k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import materialise

SAMPLE = 4096  # vectors that choose the centres and the first bounds
CENTRES = 128
PAGE = 4096
SHORT = 1e-3  # vectors of a smaller norm have no direction to speak of: a cell of their own, always compared
PAGES = "cell int, low double, high double, terms array<long>, langs array<string>, vectors binary"
TOP = "query_id long, term_id long, score double, compared long"


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / np.where(norm < SHORT, 1.0, norm)[:, None], norm


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _matrix(column) -> np.ndarray:
    """A list column as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _centres(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first: each next centre is the sample vector farthest from those before it; no two are equal."""
    units, norm = _units(sample)
    units = units[norm >= SHORT]
    if not len(units):
        return np.zeros((0, sample.shape[1]))
    chosen, far = [0], _chords(units, units[:1])[:, 0]
    while len(chosen) < most and far.max() > 1e-6:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _chords(units, units[chosen[-1] :][:1])[:, 0])
    return units[chosen]


@dataclass(frozen=True)
class MetricIndex:
    pages: DataFrame
    centres: np.ndarray
    sample: pa.Table  # term_id, lang, vector


def build(terms: DataFrame, vector: str = "vector", centres: int = CENTRES, page: int = PAGE) -> MetricIndex:
    """The index of terms (term_id, lang, vector): one shuffle that sorts by cell and distance. Terms without a vector aren't in it."""
    rows = terms.select(F.col("term_id").cast("long").alias("term_id"), "lang", F.col(vector).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())
    sample = rows.withColumn("_h", F.xxhash64("term_id", "vector")).orderBy("_h").limit(SAMPLE).drop("_h").toArrow()
    middle = _centres(_matrix(sample["vector"]), centres) if sample.num_rows else np.zeros((0, 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            units, norm = _units(_matrix(b.column("vector")))
            chord = _chords(units, middle) if len(middle) else np.zeros((len(units), 1))
            cell, far = chord.argmin(axis=1), chord.min(axis=1)
            short = norm < SHORT
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(short, -1, cell).astype(np.int32)), pa.array(np.where(short, 0.0, far))], names=[*b.schema.names, "cell", "far"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pages(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            cell = t["cell"].to_numpy()
            ends = [*np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
            at, out = 0, []
            for k, end in enumerate(ends):
                while at < end and (end - at >= page or last or k < len(ends) - 1):
                    part = t.slice(at, min(page, end - at))
                    far = part["far"]
                    out.append((int(cell[at]), far[0].as_py(), far[-1].as_py(), part["term_id"].to_pylist(), part["lang"].to_pylist(), _matrix(part["vector"]).tobytes()))
                    at += part.num_rows
            if at < len(cell):
                held.extend(t.slice(at).to_batches())
            if out:
                kinds = (pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["cell", "low", "high", "terms", "langs", "vectors"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= 2 * page:
                yield from pages(False)
        if held:
            yield from pages(True)

    placed = rows.mapInArrow(place, "term_id long, lang string, vector array<double>, cell int, far double")
    # the hash parts terms at the same distance, as copies are
    order = ["cell", "far", F.xxhash64("term_id")]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("term_id", "lang", "vector", "cell", "far")
    return MetricIndex(materialise(dealt.mapInArrow(cut, PAGES), "pages"), middle, sample)


def search(index: MetricIndex, queries: DataFrame, k: int = 3, block: int = 10_000, least: float | None = None) -> DataFrame:
    """(query_id, term_id, score, rank): the k terms of highest cosine of each query (query_id, qvec, lang or null), ties by term.

    Queries go to the tasks in blocks of about ``block``, pages stay where they lie: a task keeps k terms a query.
    """
    scored = found(index, queries, k, block, least).where("term_id IS NOT NULL")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "term_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "term_id", "score", "rank")


def found(index: MetricIndex, queries: DataFrame, k: int, block: int = 10_000, least: float | None = None) -> DataFrame:
    """Each task's k best terms of each query, and a row without term for the pairs that it ``compared``."""
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec"), F.col("lang").cast("string").alias("lang")).where("qvec IS NOT NULL")
    n = q.count()
    blocks = -(-n // block)
    if blocks > 1:
        q = materialise(q.withColumn("_block", F.pmod(F.xxhash64("query_id", "qvec"), F.lit(blocks))), "queries")
    out = None
    for i in range(max(1, blocks)):
        mine = (q.where(F.col("_block") == i) if blocks > 1 else q).select("query_id", "qvec", "lang").toArrow()
        part = index.pages.mapInArrow(_task(index, mine, k, least), TOP)
        out = part if out is None else out.unionByName(part)
    return out


def _task(index: MetricIndex, queries: pa.Table, k: int, least: float | None):
    """The search of one block of queries over the pages of a task."""
    ids, langs = queries["query_id"].to_numpy(), np.array(queries["lang"].to_pylist(), object)
    vectors = _matrix(queries["qvec"]) if queries.num_rows else np.zeros((0, 1))
    units, norms = _units(vectors)
    unbounded = norms < SHORT
    to_centres = _chords(units, index.centres) if len(index.centres) and len(ids) else np.zeros((len(ids), 1))
    nearest = to_centres.min(axis=1, initial=np.inf)
    # the k-th distance to the sample bounds the k-th of all
    bound = np.full(len(ids), np.inf)
    if index.sample.num_rows >= k and len(ids):
        some, some_norm = _units(_matrix(index.sample["vector"]))
        chord = _chords(units, some)
        chord[:, some_norm < SHORT] = np.inf
        others = np.array(index.sample["lang"].to_pylist(), object)
        chord[(langs[:, None] != None) & (langs[:, None] != others[None, :])] = np.inf  # noqa: E711
        bound = np.partition(chord, k - 1, axis=1)[:, k - 1]
    bound[unbounded] = np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = bound.copy()
        best: dict[int, list] = {}
        compared = 0
        for b in batches:
            for r in b.to_pylist():
                terms, their = np.array(r["terms"]), np.array(r["langs"], object)
                page = np.frombuffer(r["vectors"]).reshape(len(terms), -1)
                page_norms = _units(page)[1]
                if r["cell"] < 0:
                    on = np.arange(len(ids))
                else:
                    far = to_centres[:, r["cell"]]
                    t = limit + 1e-9
                    on = np.flatnonzero((far >= r["low"] - t) & (far <= r["high"] + t) & (far - nearest <= 2 * t) | unbounded)
                for a in range(0, len(on), 512):
                    some = on[a : a + 512]
                    compared += len(some) * len(terms)
                    near = (vectors[some] @ page.T) / (norms[some, None] * page_norms[None, :] + 1e-12)
                    near[(langs[some, None] != None) & (langs[some, None] != their[None, :])] = -np.inf  # noqa: E711
                    kth = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] >= k else np.full(len(some), -np.inf)
                    for row, q in enumerate(some):
                        own = best.setdefault(int(q), [])
                        floor = max(kth[row] - 1e-9, own[-1][3] - 1e-9 if len(own) >= k else -np.inf)
                        at = np.flatnonzero((near[row] >= floor) & (near[row] > -np.inf))
                        # scores of those few one by one, so that equal vectors score the same wherever they stand
                        score = (page[at] * vectors[q]).sum(axis=1) / (norms[q] * page_norms[at] + 1e-12)
                        own += zip((-score).tolist(), terms[at].tolist(), score.tolist(), near[row][at].tolist())
                        own.sort(key=lambda x: x[:2])
                        del own[k:]
                        if len(own) == k and not unbounded[q]:
                            worst = min(x[3] for x in own)
                            limit[q] = min(limit[q], np.sqrt(max(0.0, 2.0 - 2.0 * worst)) + 1e-9)
        rows = [(int(ids[q]), t, s, None) for q, own in best.items() for _, t, s, _ in own if least is None or s >= least]
        rows.append((None, None, None, compared))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["query_id", "term_id", "score", "compared"])

    return run
