"""Token counts by prefix dynamic programming.

The tokenizer never joins what ASCII white space separates, so a text is a chain of chunks and the count at
a prefix is the count up to the last chunk end plus the count of the open chunk's own prefix. The first
part is a running sum, the second a table per distinct chunk, filled once by the library. Truncation
and budget questions are then look-ups; nothing is encoded twice.

A document's table holds the exact count at the end of every chunk. Inside a chunk of at most INSIDE characters the counts at
all its prefixes are a table of the chunk, made by the library at the first question and then looked up; a prefix that ends
inside a longer chunk is counted to that chunk's start by the table and from there by the library.

What makes this exact is checked when a tokenizer is loaded: that it lower-cases, cuts at white space, and never joins
letters, digits and other marks. One that doesn't is asked for whole texts, and has no tables.

The count at a prefix is what the library gives for that prefix as a text of its own. A null text is empty
and has no tokens. Rows are counted one by one, so ties, repeated rows and further columns need no special
case.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
INSIDE = 256
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's tasks are the parallelism
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Texts whose counts must add up for the chunk tables to be exact: across white space, marks, capitals, digits and forms.
_PROBES = ["Ab ab", "a.b", "A,", "x| y", "don't", "12 345", "é É", "  a\n\tb ", "a  b", "word. Word!", "naïve café", "it's; we'll", "a|b", "ﬁ x", "x\u0301 y"]


def splits_at_gaps(tokenizer) -> bool:
    """Whether counts of a text are sums over its chunks, as stated by the tokenizer's parts and tried on probes."""
    import json

    spec = json.loads(tokenizer.to_str())
    norm, pre = json.dumps(spec.get("normalizer") or {}), json.dumps(spec.get("pre_tokenizer") or {})
    stated = '"Lowercase"' in norm and '"Prepend"' not in norm and "Metaspace" not in pre and '"add_prefix_space": true' not in pre and spec.get("post_processor") is None
    special = all(t["content"].startswith("<|") and not t["normalized"] for t in spec.get("added_tokens", []))
    n = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    sums = all(n(t) == sum(n(c) for c in _CHUNK.findall(t)) for t in _PROBES)
    ends = all(n(f"ab{m}") == n("ab") + n(m) for m in ".,;:!?") and n("|") == 1 and n("a | b") == n("a") + 1 + n("b") and n("ABC") == n("abc")
    return stated and special and sums and ends


class Counter:
    """Counts of chunks, kept while there are at most ``keep``; longer chunks are counted but not kept."""

    def __init__(self, path: str, keep: int = 500_000, longest: int = 64) -> None:
        self.tokenizer, self.keep, self.longest = _library(path), keep, longest
        self.known: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.exact = splits_at_gaps(self.tokenizer)
        self.inner: dict[str, list[int]] = {}
        self.bar = self.tokenizer.encode("|", add_special_tokens=False).ids[0] if self.exact else -1
        self.marks = {m: self.encode(m) for m in ".,;:!?"}
        self.widest = max(map(len, self.tokenizer.get_vocab()), default=1)

    def encode(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _stem(self, chunk: str) -> tuple[str, int]:
        """A chunk as a stem that other chunks share, and the tokens of what was taken off.

        The library lower-cases and never joins a letter or digit with the mark after it, so a last mark counts on
        its own and capitals make no difference. Chunks with a special string's mark stay as they are.
        """
        if "<|" in chunk or not chunk.isascii():
            return chunk, 0
        if len(chunk) > 1 and chunk[-1] in self.marks and chunk[-2].isalnum():
            return chunk[:-1].lower(), self.marks[chunk[-1]]
        return chunk.lower(), 0

    def _stem_counts(self, stems: list[str]) -> Iterator[tuple[str, int]]:
        """Counts of stems, some hundred to a call: a lone bar between them is one token that none of them has."""
        plain = [c for c in stems if "|" not in c]
        for c in stems:
            if "|" in c:
                yield c, self.encode(c)
        for i in range(0, len(plain), 256):
            part = plain[i : i + 256]
            e = self.tokenizer.encode_batch_fast([" | ".join([*part, ""])], add_special_tokens=False)[0]
            ends = np.flatnonzero(np.array(e.ids) == self.bar)
            yield from zip(part, (np.diff(ends, prepend=-1) - 1).tolist())

    def chunk_counts(self, chunks: list[str]) -> list[int]:
        counts = list(map(self.known.get, chunks))
        if None in counts:
            found = self._learn({c for c, n in zip(chunks, counts) if n is None})
            counts = [found[c] if n is None else n for c, n in zip(chunks, counts)]
        return counts

    def _learn(self, new: set[str]) -> dict[str, int]:
        known, stems = self.known, self.stems
        if len(known) + len(new) > self.keep:
            known.clear(), stems.clear()
        parts = {c: self._stem(c) for c in new}
        fresh = dict(self._stem_counts(list({s for s, _ in parts.values() if s not in stems})))
        out = {c: n + (stems[s] if s in stems else fresh[s]) for c, (s, n) in parts.items()}
        for kept, more in ((known, out), (stems, fresh)):
            kept.update((c, n) for c, n in more.items() if len(c) <= self.longest)
        return out

    def count(self, text: str | None) -> int:
        return sum(self.chunk_counts(_CHUNK.findall(text or ""))) if self.exact else self.encode(text or "")

    def inside(self, chunk: str) -> list[int]:
        """Counts of all prefixes of a chunk, from the empty one."""
        table = self.inner.get(chunk)
        if table is None:
            if len(self.inner) > 50_000:
                self.inner.clear()
            got = self.tokenizer.encode_batch_fast([chunk[:k] for k in range(1, len(chunk) + 1)], add_special_tokens=False)
            table = self.inner[chunk] = [0, *(len(e.ids) for e in got)]
        return table

    def table(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the chunks (code points) and the token count of the text up to each."""
        found = [m.span() for m in _CHUNK.finditer(text or "")]
        counts = self.chunk_counts([text[a:b] for a, b in found])
        return np.array([b for _, b in found], np.int64), np.cumsum(counts, dtype=np.int64)

    def at(self, text: str, prefix: int, table: tuple[np.ndarray, np.ndarray] | None = None) -> int:
        """Exact count of ``text[:prefix]``."""
        if not self.exact:
            return self.encode(text[:prefix])
        ends, totals = table if table is not None else self.table(text)
        done = int(np.searchsorted(ends, prefix, "right"))
        base = int(totals[done - 1]) if done else 0
        start = int(ends[done - 1]) if done else 0
        open_ = _CHUNK.search(text, start, int(ends[done]) if done < len(ends) else len(text))
        if not open_ or open_.start() >= prefix:
            return base
        cut = prefix - open_.start()
        return base + (self.inside(open_[0])[cut] if len(open_[0]) <= INSIDE else self.chunk_counts([open_[0][:cut]])[0])

    def fit(self, text: str, budget: int, table: tuple[np.ndarray, np.ndarray] | None = None) -> int:
        """Length of the longest prefix within ``budget`` tokens.

        The chunk that it ends in is looked up at all its prefixes. In one of over INSIDE characters, as a text without white
        space is, bisection with the library finds a prefix that fits while one more character doesn't; as
        counts may dip where tokens merge, the INSIDE prefixes behind it are tried too.
        """
        ends, totals = table if table is not None else self.table(text)
        done = int(np.searchsorted(totals, budget, "right"))
        if done == len(ends):
            return len(text)
        base, start = (int(totals[done - 1]), int(ends[done - 1])) if done else (0, 0)
        open_ = _CHUNK.search(text, start)
        chunk, room = open_[0], budget - base
        if len(chunk) <= INSIDE:
            return open_.start() + max(k for k, n in enumerate(self.inside(chunk)) if n <= room)
        # a token has at most so many characters, so far fewer tokens than these don't reach further
        low, high = 0, min(len(chunk), 4 * (room + 1) * self.widest)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.encode(chunk[:middle]) <= room else (low, middle)
        near = range(low + 1, min(len(chunk), low + INSIDE) + 1)
        counts = self.tokenizer.encode_batch_fast([chunk[:k] for k in near], add_special_tokens=False)
        return open_.start() + max([low, *(k for k, e in zip(near, counts) if len(e.ids) <= room)])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, prefixes: bool = False, doc_id: str = "doc_id", text: str = "text", numbered: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) per row.

    ``fit_chars`` is the longest prefix within ``limit`` tokens, null for an over-long text of a tokenizer without tables.
    ``prefixes`` adds ends and totals, the count at the end of every chunk; ``numbered`` only how many there are.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"] + ["n_prefixes"] * numbered + ["ends", "totals"] * prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            totals, fits, ends, sums = [], [], [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                if not counter.exact:
                    n = counter.encode(t)
                    totals.append(n), fits.append(len(t) if n <= limit else None)
                    ends.append([len(t)] if t else []), sums.append([n] if t else [])
                    continue
                if prefixes or numbered:
                    table = counter.table(t)
                    n = int(table[1][-1]) if len(table[1]) else 0
                else:
                    core = t.strip(" \t\n\v\f\r")
                    n = sum(counter.chunk_counts(_GAP.split(core))) if core else 0
                totals.append(n)
                if prefixes or numbered:
                    fits.append(counter.fit(t, limit, table) if n > limit else len(t))
                    ends.append(table[0]), sums.append(table[1])
                elif n > limit:
                    fits.append(counter.fit(t, limit))
                else:
                    fits.append(len(t))
            n = np.array(totals, np.int64)
            cols = [batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit), pa.array(fits, pa.int64())]
            if numbered:
                cols.append(pa.array([len(x) for x in ends], pa.int64()))
            if prefixes:
                cols += [pa.array(x, pa.list_(pa.int64())) for x in (ends, sums)]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = slim.schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", n_prefixes long" * numbered + ", ends array<long>, totals array<long>" * prefixes
    return slim.mapInArrow(run, schema)
