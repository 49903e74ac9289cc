"""Substring dedup: removes windows of words that stand in an earlier document.

Groups of runs come together as `repeats` describes.  In a group, variable-length
prefixes split the suffixes into sets that fit in memory: a set that is too large is
split by its next word, small sets with prefixes of one length go together.  Each
set's subtree grows level by level: the suffixes below a node branch by their next
words, one, two, four and so on, by numbers that stand for the words themselves, and a
branch with one suffix is a leaf that needs no more reading.  Internal nodes as deep as a window are the repeats; all suffixes below
one but those of its first document are covered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.repeats import Units, without_covered
from tallyloom.llm.rows import doc_id, identified
from tallyloom.llm.textcols import numbered

#: Words of the shortest passage that counts.
WINDOW = 50
WORDS = Units(words=True, window=WINDOW, gram=12, within=False)
#: Suffixes of which a subtree is grown at once.
SET_SUFFIXES = 1 << 18


def prefix_sets(codes: np.ndarray, at: np.ndarray, depth_most: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Sets of suffixes: their indices in `at`, the node that each hangs below, and the length of the nodes' prefixes."""
    todo = [(np.arange(len(at)), 0)]
    while todo:
        own, depth = todo.pop()
        if len(own) <= most or depth == depth_most:
            yield own, np.zeros(len(own), np.int64), depth
            continue
        own = own[np.argsort(codes[at[own] + depth], kind="stable")]
        word = codes[at[own] + depth]
        edges = np.append(np.flatnonzero(np.diff(word, prepend=~word[:1])), len(own))
        together: list[np.ndarray] = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi - lo > most:
                todo.append((own[lo:hi], depth + 1))
            elif hi - lo > 1:
                if sum(map(len, together)) + hi - lo > most:
                    yield np.concatenate(together), np.repeat(np.arange(len(together)), [len(x) for x in together]), depth + 1
                    together = []
                together.append(own[lo:hi])
        if together:
            yield np.concatenate(together), np.repeat(np.arange(len(together)), [len(x) for x in together]), depth + 1


def labels(codes: np.ndarray, most: int) -> Callable[[np.ndarray, int], np.ndarray]:
    """Gives the next `step` words at each place as one number: equal for equal words alone."""
    names = [codes]
    while 1 << len(names) <= most:
        width = 1 << (len(names) - 1)  # two runs of so many words are named together
        names.append(numbered(pa.array(names[-1][:-width] << 32 | names[-1][width:])))

    def label(at: np.ndarray, step: int) -> np.ndarray:
        level = step.bit_length() - 1
        left = names[level][at]
        return left if step == 1 << level else left << 32 | names[level][at + step - (1 << level)]

    return label


def deep_nodes(window: int, label: Callable[[np.ndarray, int], np.ndarray], at: np.ndarray, own: np.ndarray, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that hang below internal nodes of the window's depth, and those nodes."""
    step = 1
    while depth < window and len(own):
        step = min(step, window - depth)
        branch = label(at[own] + depth, step)
        order = np.lexsort((branch, node))
        n, b = node[order], branch[order]
        new = np.ones(len(order), bool)
        new[1:] = (n[1:] != n[:-1]) | (b[1:] != b[:-1])
        child = np.cumsum(new) - 1
        inner = np.bincount(child)[child] > 1
        own, node, depth, step = own[order][inner], child[inner], depth + step, step * 2
    return own, node


def covered_by_suffix_tree(units: Units, codes: np.ndarray, first: np.ndarray, at: np.ndarray, rank: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which windows codes[at:at + window] equal one of smaller rank."""
    covered, label = np.zeros(len(at), bool), labels(codes, units.window // 2)
    for own, node, depth in prefix_sets(codes, at, units.window, SET_SUFFIXES):
        own, node = deep_nodes(units.window, label, at, own, node, depth)
        if len(own):
            least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, node, rank[own])
            covered[own] = rank[own] > least[node]
    return covered


def cut_repeated_words(docs: DataFrame) -> DataFrame:
    """Every row with what is left of its text: doc_id, n_words, n_removed, n_spans, kept (the words, joined by spaces).

    A word goes if it lies in a window of 50 words that also starts in a document with
    a smaller doc_id; windows are judged on the input.  Words are what stands between
    ASCII white space.  A null text has no words; texts under 50 words keep them all; a
    null doc_id counts as the smallest; of rows that share a doc_id none removes from
    another; no rows give no rows; columns but doc_id and text are ignored.
    """
    cut = without_covered(identified(docs, "text"), WORDS, covered_by_suffix_tree)
    return cut.select(doc_id(), F.col("n_units").alias("n_words"), "n_removed", "n_spans", F.col("kept").cast("string").alias("kept"))
