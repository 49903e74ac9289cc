"""LM scoring: stupid-backoff scores from n-gram counts of the whole corpus, relationally.

The documents' n-grams, exploded and counted in each bucket of documents, go by hash to
the partitions of one count table; there all buckets' counts of an n-gram are summed.
Counts above a bucket's own are joined back to it, where each document's n-grams look
them up and their logarithms are summed.  An n-gram that isn't answered stands in no
other bucket.  Rows between the steps are compressed runs of sorted hashes, so a shuffled
n-gram takes some six bytes, and a frequent one is a single entry for each bucket.

A document doesn't vouch for itself: its own occurrences are taken off all counts.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.jaccard import ASKED, _stepped
from tallyloom.llm.repeats import DEALT, GROUP_DOCS, batch, bucket_column, packed, unpacked
from tallyloom.llm.rows import dealt_among, doc_id, identified, parts, volume
from tallyloom.llm.textcols import Texts, Words, chunks, texts_of

#: Words of the longest n-gram; the factor of each step to a shorter one; the count of a word that no other document has.
ORDER, BACKOFF, UNSEEN = 2, 0.4, 0.5
#: Documents whose n-grams are counted together before they travel: the more, the fewer entries.
BUCKET_DOCS = 1000
#: Steps between places, counts.
PLACED = ("<u4", "<u4")
RESULT = "_doc long, _sub long, n_words long, n_backoff long, log_score double"


def grams(texts: Texts, order: int, seed: int) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words, and for each length from 1 to order the last words of all n-grams and their hashes."""
    words = Words(texts.lowered())
    hashes = words.hashes(seed)
    out = []
    for n in range(1, order + 1):
        at, found = words.windows(hashes, n)
        out.append((at + n - 1, found))
    return words, out


def _own_counts(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How often each n-gram stands in its own document."""
    order = np.argsort(hashes)
    order = order[np.argsort(row[order], kind="stable")]
    r, h = row[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(group)[group] if len(order) else 0
    return out


def _ask(order: int, n_groups: int, seed: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        found = np.concatenate([h for _, h in grams(texts_of(docs["text"]), order, seed)[1]])
        known, counts = np.unique(found, return_counts=True)
        return batch(_stepped(_part(known, n_groups), known, counts, key[0].as_py()))

    return run


def _part(hashes: np.ndarray, n_groups: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n_groups) >> np.uint64(32)).astype(np.int64)


def _answer(table: pa.Table) -> pa.Table:
    """To each bucket, the whole counts of its n-grams that others have too, by their places in what it asked."""
    part, buckets_asking = table["part"][0].as_py(), table["kind"].to_pylist()
    asked = [unpacked([x], ASKED)[0] for x in table["data"].to_pylist()]
    _, of = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in asked]), return_inverse=True)
    own = np.concatenate([x[1] for x in asked]).astype(np.int64)
    total = np.bincount(of, own).astype(np.int64)[of]
    out, at = [], 0
    for bucket, (steps, _) in zip(buckets_asking, asked, strict=True):
        mine = slice(at, at + len(steps))
        places = np.flatnonzero(total[mine] > own[mine])
        out.append((bucket, part, packed([np.diff(places, prepend=0), np.minimum(total[mine][places], (1 << 32) - 1)], PLACED)))
        at += len(steps)
    return batch(out)


def _score(order: int, n_groups: int, n_corpus: int, seed: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts_of(docs["text"])
        words, found = grams(texts, order, seed)
        known, of, total = np.unique(np.concatenate([h for _, h in found]), return_inverse=True, return_counts=True)
        firsts = np.searchsorted(_part(known, n_groups), np.arange(n_groups))
        for part, blob in zip(answers["kind"].to_pylist(), answers["data"].to_pylist(), strict=True):
            steps, counts = unpacked([blob], PLACED)[0]
            total[firsts[part] + np.cumsum(steps, dtype=np.int64)] = counts
        total, others, at = total[of], [], 0  # others: for each length, what other documents have of the n-gram that ends at a word
        del known, of
        for end, hashes in found:
            whole = np.zeros(len(words), np.int64)
            whole[end] = total[at : at + len(end)] - _own_counts(words.row[end], hashes)
            others.append(whole)
            at += len(end)
        n_words = words.counts()
        size = np.maximum(n_corpus - n_words, 1)[words.row].astype(float)
        place = np.arange(len(words)) - words.first[words.row]
        score = np.log(np.maximum(others[0], UNSEEN) / size)
        backed = np.zeros(len(words), bool)
        for n in range(2, order + 1):  # from short to long: the longest that others have gives the score
            there = place >= n - 1
            before = np.append(0, others[n - 2][:-1]) if len(words) else others[n - 2]
            use = there & (others[n - 1] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(use, np.log(others[n - 1] / before), np.where(there, score + np.log(BACKOFF), score))
            backed = np.where(there, ~use, backed)
        sums = np.bincount(words.row, score, minlength=len(texts)).astype(float)  # whole numbers if there are no words
        back = np.bincount(words.row, backed, minlength=len(texts)).astype(np.int64)
        return pa.table([docs["_doc"], docs["_sub"], pa.array(n_words.astype(np.int64)), pa.array(back), pa.array(sums)], [x.split()[0] for x in RESULT.split(", ")])

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([len(Words(texts))], pa.int64())], ["n"])


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Every row of docs: doc_id, n_words, n_backoff (words scored by a shorter n-gram), log_score, mean_log_score.

    Words are lower-cased (A-Z) and stand between ASCII white space.  A word scores the
    other documents' count of the longest n-gram that ends with it over that of the
    n-gram without it, times 0.4 for each word that was left off; a single word's count
    goes by the number of words in the other documents, and is a half if they don't have
    it.  A text without words scores 0 with a null mean.  Rows that share a doc_id are
    documents of their own; no rows give no rows; columns but doc_id and text are ignored.
    """
    size = volume(docs)
    n_buckets, n_groups = max(parts(docs), dealt_among(size, BUCKET_DOCS)), max(4 * parts(docs), dealt_among(size, GROUP_DOCS))
    total = docs.select("text").mapInArrow(_count_words, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seed = secrets.randbits(62)  # of this run, so that no one can make words with equal hashes
    by_bucket = identified(docs, "text").withColumn("bucket", bucket_column(n_buckets))
    asked = by_bucket.groupBy("bucket").applyInArrow(_ask(order, n_groups, seed), DEALT)
    answers = asked.groupBy("part").applyInArrow(_answer, DEALT)
    scored = by_bucket.groupBy("bucket").cogroup(answers.groupBy("part")).applyInArrow(_score(order, n_groups, total, seed), RESULT)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select(doc_id(), "n_words", "n_backoff", "log_score", mean.alias("mean_log_score"))
