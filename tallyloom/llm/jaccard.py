"""N-gram Jaccard join: links documents whose sets of word shingles are similar, by a grouped prefix join.

Two sets with a Jaccard similarity of t share one of the first n - ceil(t n) + 1
shingles of either, whatever order of all shingles is used; here the rare ones come
first, so a list of documents that share such a shingle is short.

1. How many documents hold a shingle is counted.  Counts travel as compressed sorted
   hashes by bucket of documents, and only those above one travel back.  So a document
   also knows how many of its shingles others have, which bounds any overlap.
2. Documents with equal sets (by two independent hashes of 64 bits a shingle) are one
   node.  Nodes with equal prefixes and sizes are one group, and only groups meet in
   the lists of prefix shingles.
3. Each list compares its groups with its first one of like size, and sets with equal
   cores (the shingles that others have) are compared with the smallest of them; the
   groups' members are expanded and verified by their words themselves, and links
   make components.  What is left are pairs in one list but different components, of
   sizes that leave room for a link: each such pair is verified as well, all of them,
   so no link between components is lost.  A list of thousands of near copies is
   thereby linear, and one of sets that share too little makes no pairs.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.repeats import BUCKET_DOCS, DEALT, GROUP_DOCS, _locate, batch, bucket_column, dealt, unpacked
from tallyloom.llm.rows import NO_ID, SPREAD, buckets, checkpointed, dealt_among, doc_id, freed, identified, parts, settled, spread, volume, whole_rows
from tallyloom.llm.textcols import Texts, Words, mix64, numbered, paired, texts_of

#: Words in a shingle; the least similarity in hundredths.
SHINGLE, SIMILARITY = 5, 80
#: Bits of a shingle's hash that its count goes by, for a million documents; more have more.
COUNT_BITS = 40
#: Pairs verified at once, on average at most; nodes of a list that meet at once, about.
GROUP_PAIRS, LIST_NODES = 2000, 4096
ASKED = ("<u8", "<u4")  # steps between sorted hashes, counts
SETS = "_doc long, _sub long, n int, common int, d1 long, d2 long, p1 long, p2 long, core long, tokens array<long>"


def _distinct(row: np.ndarray, found: np.ndarray, n_rows: int, *beside: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct values of each row, ascending, where each row's begin, and what stands beside them."""
    order = np.argsort(found)
    by_row = row[order]
    order = order[np.argsort(by_row.astype(np.uint16) if n_rows < 1 << 16 else by_row, kind="stable")]
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return found[new], np.searchsorted(row[new], np.arange(n_rows + 1)), *(x[order][new] for x in beside)


def _shingles(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle."""
    at, found = words.windows(hashes, SHINGLE)
    row, counts = words.row[at], words.counts()
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):  # the whole sequence, mixed word by word
        whole = counts[short].astype(np.uint64)
        for i in range(SHINGLE - 1):
            more = counts[short] > i
            whole[more] = paired(whole[more], hashes[words.first[short[more]] + i])
        row, found = np.concatenate([row, short]), np.concatenate([found, whole])
    return row, found


def shingle_sets(texts: Texts, seed: int, *seeds: int) -> tuple[np.ndarray, ...]:
    """The distinct shingles of all rows: hashes by a seed, ascending in each row, where each row's begin, and hashes by other seeds."""
    words = Words(texts.lowered())
    row, found = _shingles(words, words.hashes(seed))
    return _distinct(row, found, len(texts), *(_shingles(words, words.hashes(s))[1] for s in seeds))


def exact_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all rows as numbers that are equal for equal words alone, and where each row's begin."""
    words = Words(texts.lowered())
    codes = np.concatenate([words.exact() + 1, np.zeros(SHINGLE, np.int64)])  # 0 stands behind a short sequence
    counts = words.counts()
    at = np.arange(len(words))
    left = words.first[words.row + 1] - at
    at = at[(left >= SHINGLE) | ((counts[words.row] < SHINGLE) & (at == words.first[words.row]))]
    near = codes[at[:, None] + np.arange(SHINGLE)]
    near[np.arange(SHINGLE) >= left[at][:, None]] = 0
    value = near[:, 0]
    for i in range(1, SHINGLE):
        value = value << 32 | near[:, i]
        if i + 1 < SHINGLE:
            value = numbered(pa.array(value))
    return _distinct(words.row[at], value, len(texts))


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def _ask(n_groups: int, bits: int, seed: int):
    """Distinct shingles of a bucket and in how many of its documents they are, by range of hashes."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        found, _ = shingle_sets(texts_of(docs["text"]), seed)
        short, counts = np.unique(_short(found, bits), return_counts=True)
        part = ((short >> np.uint64(bits - 32)) * np.uint64(n_groups) >> np.uint64(32)).astype(np.int64)
        return batch(_stepped(part, short, counts, key[0].as_py()))

    return run


def _stepped(part: np.ndarray, short: np.ndarray, counts: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """Sorted hashes as steps, which compress well; the first of each part in full."""
    steps = np.diff(short, prepend=short[:1] * 0)
    first = np.diff(part, prepend=-1) != 0
    steps[first] = short[first]
    return dealt(part, kind, [steps, counts], ASKED)


def _answer():
    """To each bucket, its shingles that two documents or more have."""

    def run(table: pa.Table) -> pa.Table:
        asked = [unpacked([x], ASKED)[0] for x in table["data"].to_pylist()]
        sizes = [len(x[0]) for x in asked]
        short = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in asked])
        known, of = np.unique(short, return_inverse=True)
        total = np.bincount(of, np.concatenate([x[1] for x in asked])).astype(np.int64)[of]
        bucket = np.repeat(np.array(table["kind"].to_pylist()), sizes)
        often = total > 1
        return batch(_stepped(bucket[often], short[often], np.minimum(total[often], (1 << 32) - 1), 0))

    return run


def _prefixes(bits: int, seed: int):
    return lambda docs, answers: _prefix_rows(docs, answers, bits, seed)


def _prefix_rows(docs: pa.Table, answers: pa.Table, bits: int, seed: int) -> pa.Table:
    """A row of SETS for each document: size, digests of the set and of its prefix, shingles of the prefix that others have too."""
    texts = texts_of(docs["text"])
    found, first, other = shingle_sets(texts, seed, seed + 1)
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(texts)), sizes)
    known = [unpacked([x], ASKED)[0] for x in answers["data"].to_pylist()]
    short = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(x[0], dtype=np.uint64) for x in known)])
    total = np.concatenate([np.zeros(0, np.int64), *(x[1].astype(np.int64) for x in known)])
    order = np.argsort(short)
    short, total = np.append(short[order], np.iinfo(np.uint64).max), np.append(total[order], 1)
    at = np.searchsorted(short, _short(found, bits))
    rank = np.where(short[at] == _short(found, bits), total[at], 1)
    common = np.bincount(row, rank > 1, minlength=len(texts))
    order = np.lexsort((found, rank, row))
    place = np.arange(len(order)) - first[row]
    length = sizes - (sizes * SIMILARITY + 99) // 100 + 1
    prefix = order[place < length[row]]
    sums = lambda values, of: _sums(values, of, len(texts))
    d1, d2 = sums(mix64(found), row), sums(mix64(other), row)
    token, of = found[prefix], row[prefix]
    p1, p2 = sums(mix64(token), of), sums(mix64(other[prefix]), of)
    core = mix64(sums(mix64(found[rank > 1]), row[rank > 1]) + mix64(common.astype(np.uint64)))
    shared = rank[prefix] > 1
    token, of = token[shared], of[shared]
    offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(token.view(np.int64)))
    return pa.table([docs["_doc"], docs["_sub"], pa.array(sizes.astype(np.int32)), pa.array(common.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (d1, d2, p1, p2, core)), tokens], ["_doc", "_sub", "n", "common", "d1", "d2", "p1", "p2", "core", "tokens"])


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 by row; of ascends."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    edge = np.searchsorted(of, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def _verify(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The pairs that are similar enough."""
    empty = pairs.slice(0, 0)
    if not docs.num_rows or not pairs.num_rows:
        return empty.select(["a_doc", "a_sub", "b_doc", "b_sub"])
    found, first = exact_sets(texts_of(docs["text"]))
    a, b = (_locate(docs, pairs[f"{x}_doc"].to_numpy(), pairs[f"{x}_sub"].to_numpy()) for x in "ab")
    good = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        one, two = found[first[x] : first[x + 1]], found[first[y] : first[y + 1]]
        if len(one) > len(two):
            one, two = two, one
        if 100 * len(one) >= SIMILARITY * len(two) and len(one):
            both = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
            good[i] = 100 * both >= SIMILARITY * (len(one) + len(two) - both)
    return pairs.filter(pa.array(good)).select(["a_doc", "a_sub", "b_doc", "b_sub"])


def _ids(prefix: str) -> list:
    return [F.col(f"{prefix}._doc").alias(f"{prefix}_doc"), F.col(f"{prefix}._sub").alias(f"{prefix}_sub")]


def verified(rows: DataFrame, pairs: DataFrame, n_buckets: int) -> DataFrame:
    """Those pairs (a, b) of rows whose sets are similar.

    They are verified by bucket of b; where there are many, by block of a as well, so
    a group has some thousand texts.  A text goes once to each group that needs it.
    """
    flat = settled(pairs.select(*_ids("a"), *_ids("b"), "b.*").withColumn("bucket", bucket_column(n_buckets)).drop("_doc", "_sub"))
    blocks = buckets(flat.count(), n_buckets * GROUP_PAIRS)
    flat = flat.withColumn("block", F.pmod(F.xxhash64("a_doc", "a_sub"), F.lit(blocks)))
    needs = flat.select("bucket", "block", F.col("a_doc").alias("_doc"), F.col("a_sub").alias("_sub")).unionByName(flat.select("bucket", "block", F.col("b_doc").alias("_doc"), F.col("b_sub").alias("_sub"))).distinct()
    texts = needs.join(rows, ["_doc", "_sub"]).select(F.col("bucket").alias("home"), F.col("block").alias("part"), "_doc", "_sub", "text")
    good = texts.groupBy("home", "part").cogroup(flat.groupBy("bucket", "block")).applyInArrow(_verify, "a_doc long, a_sub long, b_doc long, b_sub long")
    node = lambda x: F.struct(F.col(f"{x}_doc").alias("_doc"), F.col(f"{x}_sub").alias("_sub")).alias(x)
    return settled(good.select(node("a"), node("b")))


def _can_link(a: str, b: str):
    """Whether sets of these sizes can overlap enough, as only shingles that others have can be shared."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * SIMILARITY) & (F.least(f"{a}common", f"{b}common") * (100 + SIMILARITY) >= (n + m) * SIMILARITY)


def near_copies(rows: DataFrame) -> DataFrame:
    """_doc, _sub, n_shingles and label (_doc and _sub of the first row of its component) of every row (_doc, _sub, text).

    Texts are lower-cased (A-Z) and split at ASCII white space.  A text of fewer than
    five words is one shingle; a null or empty one has none and is linked with nothing.
    Rows that share a doc_id are rows of their own; a null doc_id comes first; equal
    sets are linked; no rows give no rows; columns but doc_id and text are ignored.
    """
    size = volume(rows)
    n_buckets = max(parts(rows), dealt_among(size, BUCKET_DOCS))
    n_groups = max(4 * parts(rows), dealt_among(size, GROUP_DOCS))
    bits = min(60, COUNT_BITS + max(0, (size >> 20).bit_length()))
    seed = secrets.randbits(62)  # of this run, so that no one can make words with equal hashes
    by_bucket = rows.withColumn("bucket", bucket_column(n_buckets))
    asked = by_bucket.groupBy("bucket").applyInArrow(_ask(n_groups, bits, seed), DEALT)
    answers = asked.groupBy("part").applyInArrow(_answer(), DEALT)
    sets = checkpointed(by_bucket.groupBy("bucket").cogroup(answers.groupBy("part")).applyInArrow(_prefixes(bits, seed), SETS))
    freed(sets)

    some = sets.filter("n > 0").withColumn("id", F.struct("_doc", "_sub"))
    nodes = checkpointed(some.groupBy("n", "d1", "d2", "p1", "p2").agg(F.min("id").alias("id"), F.max("common").alias("common"), F.max("core").alias("core"), F.first("tokens").alias("tokens")))
    member = checkpointed(with_least(nodes, ["n", "p1", "p2"], F.col("id"), "grp").select("id", "grp", "n", "common", "core", "tokens"))
    freed(member)
    # a list: the groups of like size that share a shingle of their prefixes
    like = F.floor(F.log("n") / F.log(F.lit(100 / SIMILARITY))).cast("int").alias("like")
    posted = member.filter(F.col("id") == F.col("grp")).select("grp", "n", "common", like, F.posexplode("tokens").alias("place", "token"))
    to_head = with_least(posted, ["token", "like"], F.struct("grp", "n", "common"), "head").filter(F.col("grp") != F.col("head.grp")).select("grp", "head").distinct()
    stars = spread(member.select("grp", "id", F.col("n").alias("bn"), F.col("common").alias("bcommon")), to_head, ["grp"], ["id"])
    stars = stars.withColumns({"an": F.col("head.n"), "acommon": F.col("head.common")}).filter(_can_link("a", "b")).select(F.col("head.grp").alias("a"), F.col("id").alias("b"))
    inside = member.filter(F.col("id") != F.col("grp")).select(F.col("grp").alias("a"), F.col("id").alias("b"))
    # sets with equal cores overlap in them alone; if two are linked, both are with the smallest
    cored = with_least(member.filter("common > 0"), ["core"], F.struct("n", "id"), "least")
    cored = cored.filter((F.col("common") * (100 + SIMILARITY) >= (F.col("n") + F.col("least.n")) * SIMILARITY) & (F.col("id") != F.col("least.id"))).select(F.col("least.id").alias("a"), F.col("id").alias("b"))
    links = verified(rows, stars.unionByName(inside).unionByName(cored).distinct(), n_buckets)
    freed(links)

    known = components(member.select("id"), links)
    rest = _between(member, posted, known)
    freed(rest)
    if not rest.isEmpty():
        links = links.unionByName(verified(rows, rest, n_buckets))
        known = components(member.select("id"), links)
    by_set = nodes.select("n", "d1", "d2", "id").join(known, "id").select("n", "d1", "d2", "label")
    labelled = spread(sets.filter("n > 0"), by_set, ["n", "d1", "d2"], ["_doc", "_sub"]).select("_doc", "_sub", "n", "label")
    alone = sets.filter("n = 0").select("_doc", "_sub", "n", F.struct("_doc", "_sub").alias("label"))
    return labelled.unionByName(alone).select("_doc", "_sub", F.col("n").cast("long").alias("n_shingles"), "label")


def with_least(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """rows with the least value of their key, spread so that no task gets all rows of a key."""
    valued = rows.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(SPREAD))).withColumn("_value", value)
    in_part = valued.groupBy(*keys, "_part").agg(F.min("_value").alias("_least"))
    least = in_part.groupBy(*keys).agg(F.min("_least").alias(name))
    return valued.join(in_part.drop("_least").join(least, keys), [*keys, "_part"]).drop("_part", "_value")


#: Bands of size in a list: a quarter of the factor that sizes of linked sets can differ by.
_BAND = (100 / SIMILARITY) ** 0.25


def _band(n) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(_BAND)) + 1e-9).cast("int")


def _between(member: DataFrame, posted: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of nodes in one list, of sizes that can match, but in different components.

    A pair that can link does so at the first token that its sets share, where what is
    left of either, c, must be overlap enough; so later tokens, the frequent ones, seldom
    make pairs.  A set of n shingles can link with sizes of up to 1.8 c / 0.8 - n, so the
    smaller of two must allow the larger one's size and the other way round.  The smaller
    ones stand in a list under the band of their size, if any size not below their own
    is allowed; the larger ones ask the bands they can link with.  In a band of a list
    the component with the most nodes isn't compared with itself.
    """
    whole = member.select("id", "grp", "core", F.col("n"), "common").join(known, "id")
    # most lists have one component, and make no pairs; which do is seen from their groups
    labels = whole.groupBy("grp").agg(F.min("label").alias("_one"), F.max("label").alias("_other"))
    several = posted.select("token", "grp").join(labels, "grp").groupBy("token").agg(F.min("_one").alias("_one"), F.max("_other").alias("_other")).filter("_one <> _other").select("token")
    mixed = spread(posted.select("token", "grp", "place"), several, ["token"], ["grp"])
    listed = spread(whole, mixed, ["grp"], ["id"]).withColumn("left", F.col("common") - F.col("place")).withColumn("top", F.floor(F.col("left") * (100 + SIMILARITY) / SIMILARITY) - F.col("n"))
    listed = settled(listed.filter(F.col("left") * 100 >= F.col("n") * SIMILARITY).select("token", "id", "n", "left", "top", "core", "label"))
    freed(listed)
    smaller = listed.filter(F.col("top") >= F.col("n")).withColumn("band", _band(F.col("n")))
    least = F.ceil(F.col("n") * SIMILARITY / 100)
    larger = listed.filter(F.col("top") >= least).withColumn("band", F.explode(F.sequence(_band(least), _band(F.least("n", "top")))))
    # nodes are dealt by list, band and part, so that no list meets in one task
    both = smaller.select("token", "band", "label").unionByName(larger.select("token", "band", "label"))
    counted = both.groupBy("token", "band", "label").agg(F.count(F.lit(1)).alias("size"))
    mixed = counted.groupBy("token", "band").agg(F.max(F.struct("size", "label")).alias("major"), F.count(F.lit(1)).alias("labels"), F.sum("size").alias("size")).filter("labels > 1")
    mixed = settled(mixed.select("token", "band", F.col("major.label").alias("major"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("size") / LIST_NODES))).cast("int").alias("parts")))
    own = lambda side, x: spread(side, mixed, ["token", "band"], ["id"]).select("token", "band", "major", "parts", *(F.col(c).alias(x + c) for c in ("id", "n", "left", "top", "core", "label")), F.pmod(F.xxhash64("id"), F.col("parts")).alias(f"{x}part"))
    a, b = own(smaller, "a"), own(larger, "b")
    # of two nodes at least one is outside the largest component: each such node meets the whole other side
    keys = ["token", "band", "apart", "bpart"]
    a_cells = a.withColumn("bpart", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("a_major", F.col("alabel") == F.col("major"))
    b_cells = b.withColumn("apart", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("b_major", F.col("blabel") == F.col("major")).drop("major", "parts")
    fits = (F.col("an") <= F.col("bn")) & (F.col("bn") <= F.col("atop")) & (F.col("an") <= F.col("btop")) & (F.least("aleft", "bleft") * (100 + SIMILARITY) >= (F.col("an") + F.col("bn")) * SIMILARITY)
    fits = fits & (F.col("acore") != F.col("bcore")) & (F.col("alabel") != F.col("blabel")) & ~((F.col("an") == F.col("bn")) & (F.col("aid") > F.col("bid")) & (F.col("btop") >= F.col("bn")))
    found = [a_cells.filter(~F.col("a_major")).join(b_cells, keys), a_cells.filter(F.col("a_major")).join(b_cells.filter(~F.col("b_major")), keys)]
    return settled(found[0].unionByName(found[1]).filter(fits).select(F.col("aid").alias("a"), F.col("bid").alias("b")).distinct())


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id in reach of links) of every row, as near_copies has them."""
    first = F.col("label._doc")
    return near_copies(identified(docs, "text")).select(doc_id(), "n_shingles", F.when(first != NO_ID, first).alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that come first in their components."""
    rows = whole_rows(docs)
    first = near_copies(rows.select("_doc", "_sub", "text")).filter((F.col("label._doc") == F.col("_doc")) & (F.col("label._sub") == F.col("_sub"))).select("_doc", "_sub")
    return rows.join(first, ["_doc", "_sub"]).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
