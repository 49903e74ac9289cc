"""Spelling variants by symmetric deletes: counts, keys, joins, verified pairs, forms and their roots.

Runs of letters are counted inside the scan, so one row a distinct word leaves a
task (or a stretch of it), however often the word stands there.  Every word that is
long and frequent enough emits itself and its distinct single deletions, a row for
each under a 64-bit hash of the key.  Words that meet under a key are candidates;
`levenshtein` with a bound settles each by the words themselves, so a hash that two
keys share makes no link.  A key is shared by the words that have one letter more, at
most 90 for each of its places: groups are bounded by the alphabet, not by the input.
Each word takes its most frequent near word as its form, if that is frequent enough;
forms are at least FORM_RATIO times as frequent, so chains are short and pointer
jumping takes them to their roots in a few joins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.rows import settled

#: Letters of a run once A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent as the word.
FORM_RATIO = 5
#: One in so many distinct runs of a document loses a code point.
DROPPED = 199
#: Distinct words that a task counts before it passes them on, and rows it turns into strings at once.
HELD_WORDS, HELD_ROWS = 400_000, 64


def _thinned(run: str, before: int) -> str:
    """The run, or what its checksum (that of `<doc_id>:` is given) leaves of it."""
    h = crc32(run.encode(), before)
    if h % DROPPED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def passed_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for begin in range(0, batch.num_rows, HELD_ROWS):
            part = batch.slice(begin, HELD_ROWS)
            for name, text in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                before = crc32(f"{name}:".encode())
                for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    word = _thinned(run, before)
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
            if len(counts) >= HELD_WORDS:
                yield passed_on()
    if counts:
        yield passed_on()


def frequent_words(docs: DataFrame) -> DataFrame:
    """id, word and n of the words that are long and frequent enough; ids are any distinct numbers, and stay as they are."""
    texts = docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), "text")
    counts = texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return settled(counts.filter(F.col("n") >= LEAST_COUNT).withColumn("id", F.monotonically_increasing_id()))


def emitted(words: DataFrame) -> DataFrame:
    """id and key: a row for the word itself and one for each of its distinct single deletions.

    Deleting any letter of a stretch of equal ones leaves the same, so the first of each
    is deleted.  Deletions are made row by row: a word of 20,000 letters never has all of
    its own in one row.
    """
    at = lambda i: F.col("word").substr(i, F.lit(1))
    placed = words.select("id", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    firsts = placed.filter((F.col("i") == 1) | (at(F.col("i")) != at(F.col("i") - 1)))
    left = F.concat(F.col("word").substr(F.lit(1), F.col("i") - 1), F.col("word").substr(F.col("i") + 1, F.length("word")))
    return words.select("id", F.xxhash64("word").alias("key")).unionByName(firsts.select("id", F.xxhash64(left).alias("key")))


def near_pairs(words: DataFrame) -> DataFrame:
    """a and b, each with id, word and n: the pairs of words that differ by exactly one code point, once each."""
    keys = emitted(words)
    met = keys.select("key", F.col("id").alias("a")).join(keys.select("key", F.col("id").alias("b")), "key").filter(F.col("a") < F.col("b")).select("a", "b").distinct()
    side = lambda x: words.select(F.col("id").alias(x), F.struct("id", "word", "n").alias(f"{x}_word"))
    both = met.join(side("a"), "a").join(side("b"), "b")
    return both.filter(F.levenshtein("a_word.word", "b_word.word", 1) == 1).select(F.col("a_word").alias("a"), F.col("b_word").alias("b"))


def roots(forms: DataFrame) -> DataFrame:
    """id and root of every row of forms (id, up), by pointer jumping; chains have no loops, as each step is more frequent."""
    known = settled(forms.select("id", F.col("up").alias("root")))
    while True:
        above = known.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = settled(known.join(above, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        known = jumped.select("id", "root")
        if jumped.filter("moved").isEmpty():
            return known


def _best() -> Column:
    """The near word of largest n; of these the smallest in code-point order, which is the order of UTF-8 bytes."""
    return F.min(F.struct((-F.col("near.n")).alias("less"), F.col("near.word").alias("word"), F.col("near.id").alias("id")))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    Words come from the maximal runs of ASCII and Latin-1 letters of all texts, A-Z
    lower-cased, less the code point that a run's checksum drops; those of at least
    LEAST_LENGTH code points that stand LEAST_COUNT times or more are kept.  A null text
    has no runs; a null doc_id counts as the text `null`; rows that repeat each count;
    of near words with equal n the smallest is the form; a word without a form is its
    own root; no words give no rows; columns but doc_id and text are ignored.
    """
    words = frequent_words(docs)
    pair = near_pairs(words)
    each = pair.select(F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("near")), F.struct(F.col("b").alias("own"), F.col("a").alias("near")))).alias("p")).select("p.own", "p.near")
    nearest = settled(each.groupBy(F.col("own.id").alias("id"), F.col("own.n").alias("own_n")).agg(F.count(F.lit(1)).alias("n_near"), _best().alias("best")))
    formed = nearest.filter(-F.col("best.less") >= FORM_RATIO * F.col("own_n")).select("id", F.col("best.id").alias("up"), F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"))
    ended = roots(formed).join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    told = words.join(nearest.select("id", "n_near"), "id", "left").join(formed.drop("up"), "id", "left").join(ended, "id", "left")
    return told.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
