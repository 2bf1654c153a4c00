"""Distances between strings and vectors. The weighted distance is an Arrow function: one dynamic program for a whole batch of pairs, a cell
of all its tables at a time. The others are higher-order functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substitution costs of look-alike characters; the pair is in order. Any other substitution costs 1.
STATIC_COSTS = {
    "0,o": 0.1, "d,o": 0.3, "0,d": 0.3, "o,q": 0.2, "1,l": 0.2, "1,i": 0.2, "i,l": 0.1, "l,|": 0.2, "5,s": 0.3, "8,b": 0.3, "6,g": 0.1, "6,b": 0.3, "2,z": 0.2, "9,g": 0.1, "9,q": 0.4,
    "n,r": 0.3, "m,n": 0.4, "u,v": 0.3, "n,u": 0.5, "c,e": 0.5, "b,h": 0.5, "p,q": 0.4, "f,t": 0.4, "i,j": 0.4, "v,w": 0.4, "e,f": 0.4, "a,e": 0.4, "a,o": 0.4, "e,i": 0.4, "f,l": 0.4,
    "e,s": 0.5, "b,d": 0.4, "i,t": 0.1, "g,q": 0.2, "1,j": 0.2, "c,x": 0.2, "3,s": 0.2, "k,x": 0.3, "s,x": 0.3, "t,x": 0.3, "a,u": 0.3, "o,u": 0.3, "a,g": 0.3, "d,g": 0.3, "g,o": 0.3,
    "h,n": 0.3, "b,q": 0.2, "d,q": 0.2, "4,a": 0.1, "4,e": 0.2, "4,o": 0.2, "0,n": 0.2, "3,b": 0.2, "6,e": 0.1, "s,z": 0.3, "m,w": 0.3, "j,l": 0.2,
}
#: The costs of the graph engine's own distance.
CORE_COSTS = {"0,o": 0.1, "1,l": 0.2, "1,i": 0.2, "5,s": 0.3, "8,b": 0.3, "6,g": 0.4, "m,n": 0.4, "u,v": 0.5, "c,e": 0.5, "d,o": 0.3, "f,t": 0.4, "a,e": 0.4, "a,o": 0.4, "e,i": 0.4, "f,l": 0.4, "b,d": 0.4}


def cost_map(costs: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in sorted(costs.items()) for x in (k, v)])


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row a word, 0 behind its end; and the lengths."""
    size = np.array([len(w) for w in words])
    wide = np.array(words, dtype=f"<U{max(1, int(size.max(initial=0)))}")
    return wide.view(np.uint32).reshape(len(words), -1), size


def distances(a: list[str], b: list[str], costs: np.ndarray, together: int = 4096) -> np.ndarray:
    """Weighted distances of pairs of words. costs: of substitutions between the first 128 characters; any other costs 1."""
    out = np.zeros(len(a))
    # pairs of like length share a table, so that a long word makes no other one's larger
    order = sorted(range(len(a)), key=lambda i: max(len(a[i]), len(b[i])))
    for lo in range(0, len(order), together):
        at = np.array(order[lo : lo + together])
        x, nx = _letters([a[i] for i in at])
        y, ny = _letters([b[i] for i in at])
        row = np.repeat(np.arange(y.shape[1] + 1, dtype=float)[:, None], len(at), 1)  # by place in b, then pair
        found = np.where(nx == 0, ny, 0).astype(float)
        for i in range(x.shape[1]):
            ch, done = x[:, i], np.empty_like(row)
            done[0] = i + 1
            for j in range(y.shape[1]):
                other = y[:, j]
                known = costs[np.minimum(ch, 127), np.minimum(other, 127)]
                sub = np.where(ch == other, 0.0, np.where((ch < 128) & (other < 128), known, 1.0))
                done[j + 1] = np.minimum(np.minimum(row[j + 1] + 1, done[j] + 1), row[j] + sub)
            row = done
            ends = np.flatnonzero(nx == i + 1)
            found[ends] = row[ny[ends], ends]
        out[at] = found
    return out


def cost_table(costs: dict[str, float]) -> np.ndarray:
    table = np.ones((128, 128))
    for pair, cost in costs.items():
        x, y = map(ord, pair.split(","))
        table[x, y] = table[y, x] = cost
    return table


def weighted_distance(a: Column, b: Column, costs: dict[str, float] = STATIC_COSTS) -> Column:
    """Levenshtein distance without regard to case; insertion and deletion cost 1, a substitution what costs say. Null where either is.

    Marked as non-deterministic so that a filter on it isn't pushed below it, which would compute it twice."""
    table = cost_table(costs)

    def whole_batch(x: pd.Series, y: pd.Series) -> pd.Series:
        given = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        out[given] = distances(x[given].tolist(), y[given].tolist(), table)
        return pd.Series(out, dtype="Float64").where(given)

    return F.pandas_udf(whole_batch, "double").asNondeterministic()(F.lower(a), F.lower(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is all zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
