"""Trust in recognised text: risk signals, calibration, score, bins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.session import materialise

# Marks of a reader that gave up.
GIVE_UP = ["▢▢▢", "[unreadable]", "[illegible]", "<unclear>", "????", ".....", "-----"]
LEVELS = ["none", "low", "medium", "high"]
RISK_VALUE = [0.0, 0.0, 0.5, 1.0]


def gave_up(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for m in GIVE_UP:
        out = out | F.contains(low, F.lit(m))
    return out


def _repeating(texts: list[str], window: int) -> np.ndarray:
    """Of each text, whether some window of it occurs three times: windows of all, hashed with their text's place and sorted."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) for t in texts])
    m = max(0, len(codes) - window + 1)
    h = (own[:m] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    for k in range(window):
        h = (h + codes[k : k + m] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside = own[:m] == own[window - 1 :]
    h, own = h[inside], own[:m][inside]
    s = np.sort(h)
    found = np.zeros(len(texts), bool)
    found[own[np.isin(h, s[2:][s[2:] == s[:-2]])]] = True
    return found


def repeats(text: Column, window: int = 6) -> Column:
    """Some substring of ``window`` characters occurs three times, overlaps counted (STR-12).

    Windows of some 2^18 characters of texts at a time are told apart by 64-bit hashes. Linearithmic.
    """

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        out, group, size = np.zeros(len(texts), bool), [], 0
        for i, t in enumerate(texts):
            if t is not None and len(t) >= 3 * window:
                group.append((i, t))
                size += len(t)
            if group and (size >= 1 << 18 or i == len(texts) - 1):
                out[[j for j, _ in group]] = _repeating([x for _, x in group], window)
                group, size = [], 0
        return pd.Series(out)

    return run(text)


def plausible_length(text: Column, area: Column, pixels: Column, least: float = 1e-4) -> Column:
    """Enough characters for the box's pixels; true where the geometry is missing (STR-15)."""
    return F.coalesce(F.length(strip(text)) >= F.greatest(F.lit(1.0), area * pixels) * least, F.lit(True))


def risk_level(text: Column, *signals: Column) -> Column:
    """0 none to 3 high: two levels for each signal, none for blank text (STR-16)."""
    n = sum((s.cast("int") for s in signals), F.lit(0))
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", 0).otherwise(F.least(F.lit(3), 2 * n))


def cross_checked(level: Column, text: Column, second: Column, error: Column, threshold: float = 0.4) -> Column:
    """A level raised by two where another reading of the block, compared whole, differs by more than ``threshold`` of its length.

    A check that failed or gave no text can't be told from one that would have differed: none becomes low, others stay.
    Blank text isn't checked.
    """
    failed = error.isNotNull() | second.isNull()
    differs = F.coalesce(beyond(text, second, threshold, most=None), F.lit(False))
    raised = F.when(failed, F.greatest(level, F.lit(1))).when(differs, F.least(F.lit(3), level + 2)).otherwise(level)
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", 0).otherwise(raised)


def normalised_distance(a: Column, b: Column, most: int = 1024) -> Column:
    """Edit distance over the longer length, of the first ``most`` characters (STR-14)."""
    x, y = F.substring(a, 1, most), F.substring(b, 1, most)
    return (
        F.when((x == "") & (y == ""), 0.0)
        .when((x == "") | (y == ""), 1.0)
        .otherwise(F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))
    )


def _beyond(a: str, b: str, share: float) -> bool:
    """Whether the edit distance is over ``share`` of the longer length: a column of the table at a time as bits of a number (Myers 1999).

    What is left of ``b`` can lower the distance by one a character, so most pairs are decided before its end.
    """
    if len(a) < len(b):
        a, b = b, a
    n = len(a)
    if a == b or (n - len(b)) / n > share:
        return a != b
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    ones, top, d = (1 << n) - 1, 1 << n - 1, n
    plus, minus = ones, 0
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        x = at.get(c, 0)
        vertical = x | minus
        x = (((x & plus) + plus) ^ plus) | x
        up, down = minus | ~(x | plus) & ones, plus & x
        d += 1 if up & top else -1 if down & top else 0
        if (d - left) / n > share:
            return True
        up, down = up << 1 & ones | 1, down << 1 & ones
        plus, minus = down | ~(vertical | up) & ones, up & vertical
    return d / n > share


def beyond(a: Column, b: Column, share: float, most: int | None = 1024) -> Column:
    """``normalised_distance`` is over ``share`` (not below 0), without the distance itself: equal texts and lengths too far apart don't reach Python.

    Without ``most`` whole texts are compared.
    """
    x, y = (c if most is None else F.substring(c, 1, most) for c in (a, b))
    p, q = F.length(x), F.length(y)
    far = (F.greatest(p, q) - F.least(p, q)) / F.greatest(p, q, F.lit(1)) > share

    @F.pandas_udf("boolean")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else _beyond(u, v, share) for u, v in zip(s, t)], dtype="object")

    near = (x != y) & ~far
    return F.when(x.isNull() | y.isNull(), None).when(x == y, False).when(far, True).otherwise(run(F.when(near, x), F.when(near, y)))


def calibrate(raw: Column, a: Column | float | None, b: Column | float | None) -> Column:
    """Clamped raw through a sigmoid; without parameters the clamped raw (MATH-03)."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    if a is None or b is None:
        return r
    a, b = (c if isinstance(c, Column) else F.lit(float(c)) for c in (a, b))
    z = a * r + b
    s = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
    return F.coalesce(s, r)


def fit_platt(rows: DataFrame, raw: str, target: str, rate: float = 0.1, rounds: int = 200, tol: float = 1e-7) -> tuple[float, float]:
    """Slope and offset of a sigmoid by gradient descent with backtracking from (1, 0) (MATH-04).

    Rows of the same raw and target are counted together once; each step is one aggregate over the counts: loss
    and gradient at four halvings of the step at once. The driver gets those sums, at every size. (1, 0) where there are no rows.
    """
    x, y = F.col(raw).cast("double"), F.col(target).cast("double")
    pairs = rows.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    pairs = materialise(pairs, "pairs")
    pairs = pairs.coalesce(pairs.count() // 1_000_000 + 1).persist()  # read once a step, and on disk if lost

    def sums(points: list[tuple[float, float]]) -> list[tuple[float, float, float]]:
        """(loss, gradient of a, gradient of b) at each point."""
        # points come as one literal array, not in the expressions, so every step runs the same generated code
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(points)]))
        each = pairs.select("x", "y", "n", at.alias("p"))
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), 1 / (1 + F.exp(-(F.col("p.a") * F.col("x") + F.col("p.b"))))))
        values = (-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p)), (p - F.col("y")) * F.col("x"), p - F.col("y"))
        got = each.groupBy("p.i").agg(*[F.sum(F.col("n") * v) / F.sum("n") for v in values]).collect()
        return [tuple(r)[1:] for r in sorted(got, key=lambda r: r[0])]

    try:
        a, b = 1.0, 0.0
        first = sums([(a, b)])
        if not first:
            return a, b
        now = first[0]
        for _ in range(rounds):
            steps = [rate / 2**k for k in range(4)]
            while True:
                tried = sums([(a - s * now[1], b - s * now[2]) for s in steps])
                good = next((i for i, t in enumerate(tried) if t[0] <= now[0]), None)
                if good is not None or steps[-1] <= 1e-10:
                    break
                steps = [s / 16 for s in steps]
            if good is None or now[0] - tried[good][0] < tol:
                break
            a, b, now = a - steps[good] * now[1], b - steps[good] * now[2], tried[good]
        return a, b
    finally:
        pairs.unpersist()


def trust_score(conf: Column, level: Column, watermark: Column, mismatch: Column) -> Column:
    """Confidence less the penalties of risk, watermark and script (MATH-05)."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(conf, F.lit(0.0))))
    value = F.element_at(F.array(*[F.lit(v) for v in RISK_VALUE]), level + 1)
    return c * (1.0 - 0.5 * value) * F.when(watermark, 0.7).otherwise(1.0) * F.when(mismatch, 0.8).otherwise(1.0)


def trust_flags(conf: Column, level: Column, watermark: Column, mismatch: Column) -> Column:
    """Names of what lowered the score, in order; null where nothing did."""
    flags = F.array_compact(F.array(
        F.when(level > 0, "hallucination_risk"), F.when(watermark, "watermark_hit"), F.when(mismatch, "script_mismatch"),
        F.when(F.coalesce(conf, F.lit(0.0)) < 0.5, "low_calibrated_conf"),
    ))
    return F.when(F.size(flags) > 0, flags)


def trust_bin(score: Column) -> Column:
    """Half-open fifths, the last closed (AGG-05)."""
    return F.when(score < 0.2, "0.0-0.2").when(score < 0.4, "0.2-0.4").when(score < 0.6, "0.4-0.6").when(score < 0.8, "0.6-0.8").otherwise("0.8-1")
