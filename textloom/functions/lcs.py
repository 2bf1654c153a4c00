"""Longest common subsequences of word lists, a batch at a time: a row of the table is the bits of one number.

A set bit j of a row says that the length doesn't grow at the j-th word of the second list, so a whole row is made from the one before by an
addition and a few bit operations. The way back needs a pair of rows at a time; every r-th row is kept, r about the root of the number
of rows, and the rows between are made again block by block, so long lists take their root's memory, not their square.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _masks(b: list) -> dict:
    masks: dict = {}
    for j, y in enumerate(b):
        masks[y] = masks.get(y, 0) | 1 << j
    return masks


def _rows(a: Iterable, masks: dict, row: int, every: int) -> Iterable[int]:
    for x in a:
        if common := row & masks.get(x, 0):
            row = ((row + common) | (row - common)) & every
        yield row


def length(a: list, b: list) -> int:
    """Of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    every = row = (1 << len(b)) - 1
    for row in _rows(a, _masks(b), every, every):
        pass
    return len(b) - row.bit_count()


def matched(a: list, b: list) -> list[int]:
    """The places of b that a longest common subsequence takes, ascending. Of several the one that a way back from the ends finds: equal words are taken, else a word of a is left where that costs nothing, else one of b."""
    every, masks = (1 << len(b)) - 1, _masks(b)
    step = max(1, math.isqrt(len(a)))
    kept = [every]  # the rows before words 0, step, 2 * step, ...
    for i, row in enumerate(_rows(a, masks, every, every), 1):
        if i % step == 0:
            kept.append(row)
    found, j = [], len(b)
    for block in range((len(a) - 1) // step, -1, -1) if a else ():
        lo = block * step
        rows = [kept[block], *_rows(a[lo : lo + step], masks, kept[block], every)]
        i = len(rows) - 1
        while i > 0 and j > 0:
            if a[lo + i - 1] == b[j - 1]:
                found.append(j - 1)
                i, j = i - 1, j - 1
            else:
                low = (1 << j) - 1
                if (rows[i - 1] & low).bit_count() == (rows[i] & low).bit_count():
                    i -= 1
                else:
                    j -= 1
    return found[::-1]


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of words; null if either is."""

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else length(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return F.pandas_udf(batch, "int")(a, b)


def lcs_matched(a: Column, b: Column) -> Column:
    """The places (from 0) of b's words that a longest common subsequence with a takes, ascending; null if either is."""

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else matched(list(p), list(q)) for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(batch, "array<int>")(a, b)


def flips(before: Column, after: Column, truth: Column) -> Column:
    """Struct (n, matched_before, matched_after, fixes, regressions): words of the truth that the reading before and after correction hold in order, those gained and those lost. Arrays of words, compared in lower case; nulls count as empty."""
    lower = lambda ws: F.transform(F.coalesce(ws, F.array().cast("array<string>")), F.lower)
    truth = lower(truth)
    x, y = lcs_matched(lower(before), truth), lcs_matched(lower(after), truth)
    return F.struct(F.size(truth).alias("n"), F.size(x).alias("matched_before"), F.size(y).alias("matched_after"), F.size(F.array_except(y, x)).alias("fixes"), F.size(F.array_except(x, y)).alias("regressions"))
