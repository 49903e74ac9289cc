"""Suffix-array dedup: removes strings of bytes that stand earlier already.

Groups of runs come together as `repeats` describes.  For each group the suffixes of
its segments are sorted by the difference-cover algorithm: the suffixes at places
that aren't multiples of three are named by their first three characters, ranked by
recursion on the names, the others are sorted by their first character and the rank
behind it, and both are merged.  Windows next to each other in the array are
compared, and those equal to an earlier one are covered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.repeats import Units, without_covered
from tallyloom.llm.rows import doc_id, identified, whole_rows

#: Bytes of the shortest string that counts.
WINDOW = 100
BYTES = Units(words=False, window=WINDOW, gram=32, within=True)


def _names(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The sorted order of tuples of small numbers, each one's name by that order (from 1), and how many names there are."""
    key = columns[0].astype(np.uint64)
    for c in columns[1:]:
        key = key * np.uint64(int(c.max(initial=0)) + 1) + c.astype(np.uint64)
    order = np.argsort(key)
    new = np.diff(key[order], prepend=key[order[:1]]) != 0
    rank = np.cumsum(new) + 1
    names = np.empty(len(key), np.int64)
    names[order] = rank
    return order, names, int(rank[-1]) if len(rank) else 0


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Places of all suffixes of codes (whole numbers from 1) in order."""
    n = len(codes)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: codes[i:].tolist()), np.int64)
    padded = np.zeros(n + 4, np.int64)
    padded[:n] = codes
    one, two, nil = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])  # the last triple of `one` holds a 0, which keeps the halves apart
    if int(codes.max()) >= 1 << 20:
        _, pair, _ = _names(padded[sample], padded[sample + 1])
        order, names, distinct = _names(pair, padded[sample + 2])
    else:
        order, names, distinct = _names(padded[sample], padded[sample + 1], padded[sample + 2])
    if distinct < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    in_order = sample[order]
    in_order = in_order[in_order < n]
    top = len(sample) + 2
    first, second = in_order[in_order % 3 == 1], in_order[in_order % 3 == 2]
    key = lambda i: padded[i] * top + rank[i + 1]
    nil = nil[np.argsort(key(nil), kind="stable")]
    _, pair, _ = _names(np.concatenate([padded[second], padded[nil]]), np.concatenate([padded[second + 1], padded[nil + 1]]))
    before_first = np.searchsorted(key(first), key(nil))
    before_second = np.searchsorted(pair[: len(second)] * top + rank[second + 2], pair[len(second) :] * top + rank[nil + 2])
    out = np.empty(n, np.int64)
    at = before_first + before_second + np.arange(len(nil))
    out[at] = nil
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = in_order
    return out


def covered_by_suffix_array(units: Units, codes: np.ndarray, first: np.ndarray, at: np.ndarray, rank: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which windows codes[at:at + window] equal one of smaller rank."""
    apart = np.zeros(len(codes) + len(first) - 1, np.int64)  # a code of its own ends each segment
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first))
    apart[np.arange(len(codes)) + segment] = codes.astype(np.int64) + 2
    apart[first[1:] + np.arange(len(first) - 1)] = 1
    order = suffix_array(apart)
    asked = np.full(len(apart), -1, np.int64)
    asked[at + of] = np.arange(len(at))
    window = asked[order]
    window = window[window >= 0]
    same = np.zeros(len(window), bool)
    sights = np.lib.stride_tricks.sliding_window_view(codes, units.window)
    for lo in range(1, len(window), 1 << 15):
        hi = min(len(window), lo + (1 << 15))
        same[lo:hi] = (sights[at[window[lo:hi]]] == sights[at[window[lo - 1 : hi - 1]]]).all(axis=1)
    group = np.cumsum(~same)
    least = np.full(len(window) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, rank[window])
    covered = np.zeros(len(at), bool)
    covered[window] = rank[window] > least[group]
    return covered


def cut_repeated_bytes(docs: DataFrame) -> DataFrame:
    """Every row with what is left of its text: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    A byte goes if it lies in a string of 100 bytes that also starts earlier: in a
    document with a smaller doc_id, or earlier in its own.  Strings are judged on the
    input.  A null text is empty; texts under 100 bytes stay as they are; a null
    doc_id counts as the smallest; rows that share a doc_id are ordered by a
    hash of their texts; no rows give no rows; columns but doc_id and text are ignored.
    """
    return without_covered(identified(docs, "text"), BYTES, covered_by_suffix_array).select(doc_id(), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with such strings cut from text; characters cut in two go as well, and n_chars follows."""
    columns = docs.columns
    rows = whole_rows(docs)
    kept = without_covered(rows.select("_doc", "_sub", "text"), BYTES, covered_by_suffix_array, as_text=True).select("_doc", "_sub", F.col("kept").cast("string").alias("_kept"))
    joined = rows.join(kept, ["_doc", "_sub"])
    values = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    return joined.select(*(values.get(c, F.col("_row").getField(c)).alias(c) for c in columns))
