"""Texts made to collide under polynomial hashes, rows made by joins as inputs grow, and rows that share ids."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import jaccard, repeats
from tallyloom.llm.jaccard import exact_sets, jaccard_components, shingle_sets
from tallyloom.llm.lm import lm_scores
from tallyloom.llm.rows import dealt_among, identified, spread
from tallyloom.llm.suffix_array import BYTES, cut_repeated_bytes
from tallyloom.llm.suffix_tree import cut_repeated_words
from tallyloom.llm.textcols import Words, combined, mix64, named, texts_of


def thue_morse(n: int, zero: str = "a", one: str = "b") -> list[str]:
    return [one if bin(i).count("1") % 2 else zero for i in range(n)]


T, U = "".join(thue_morse(1024)), "".join(thue_morse(1024, "b", "a"))


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_words_that_polynomials_confuse(spark):
    head, tail = " ".join(f"h{i}" for i in range(30)), " ".join(f"t{i}" for i in range(30))
    cut = {r.doc_id: r.n_removed for r in cut_repeated_words(_docs(spark, [f"{head} {T} {tail}", f"{head} {U} {tail}"])).collect()}
    assert cut == {1: 0, 2: 0}
    assert {r.doc_id: r.component_id for r in jaccard_components(_docs(spark, [T, U])).collect()} == {1: 1, 2: 2}
    scores = {r.doc_id: r.log_score for r in lm_scores(_docs(spark, [T, U, "x"])).collect()}
    assert scores[1] == scores[2] == pytest.approx(np.log(0.5 / 2))


def test_sequences_that_polynomials_confuse(spark):
    one, two = " ".join(thue_morse(2048, "x", "y")), " ".join(thue_morse(2048, "y", "x"))
    docs = _docs(spark, [one, two, one + " z"])
    got = {r.doc_id: r.n_removed for r in cut_repeated_words(docs).collect()}
    seen, want = {}, {}
    for i, t in enumerate([one, two, one + " z"], 1):
        words = t.split()
        gone = [False] * len(words)
        for k in range(len(words) - 49):
            if seen.setdefault(tuple(words[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        want[i] = sum(gone)
    assert got == want
    raw = {r.doc_id: r.n_removed for r in cut_repeated_bytes(_docs(spark, [T[:512] + "c", U[:512] + "c"])).collect()}
    seen, want = set(), {}
    for i, t in enumerate([T[:512] + "c", U[:512] + "c"], 1):
        gone = [False] * len(t)
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(t[k : k + 100])
        want[i] = sum(gone)
    assert raw == want


def test_hashes_and_names():
    r = random.Random(4)
    words = ["".join(r.choice("ab\0é") for _ in range(r.choice([1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 700]))) for _ in range(500)]
    words += words[:100]
    column = Words(texts_of(pa.array([" ".join(words[:300]), "", None, " ".join(words[300:])])))
    for numbers in (column.hashes(), column.hashes(1), column.exact()):
        known: dict = {}
        assert all(known.setdefault(w, n) == n for w, n in zip(words, numbers.tolist(), strict=True))
        assert len(set(known.values())) == len(known)
    assert not set(column.hashes().tolist()) & set(column.hashes(1).tolist())
    values = np.array([r.randrange(3) for _ in range(200)])
    for k in (1, 2, 3, 5, 8, 12, 50):
        runs = [tuple(values[i : i + k].tolist()) for i in range(200 - k + 1)]
        for numbers in (combined(mix64(values.astype(np.uint64)), k), named(values, k)):
            known = {}
            assert len(numbers) == len(runs) and all(known.setdefault(w, n) == n for w, n in zip(runs, numbers.tolist(), strict=True))
            assert len(set(known.values())) == len(known)


def test_exact_sets():
    r = random.Random(6)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(40))) for _ in range(60)] + ["", "a b c d", "a b c d", "a b c d a"]
    chunk = texts_of(pa.array(texts))
    hashes, first, _ = shingle_sets(chunk, 0, 1)
    exact, first_exact = exact_sets(chunk)
    assert first.tolist() == first_exact.tolist()
    for x, a in enumerate(texts):
        for y, b in enumerate(texts):
            p, q = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} or ({tuple(t.split())} if t else set()) for t in (a, b))
            assert len(p & q) == len(np.intersect1d(exact[first[x] : first[x + 1]], exact[first[y] : first[y + 1]])) == len(np.intersect1d(hashes[first[x] : first[x + 1]], hashes[first[y] : first[y + 1]]))


def test_lists_without_links_make_no_pairs(spark, monkeypatch):
    """89 shared words and 15 of their own: similar, but not enough; the join must not look at all pairs."""
    made = []
    between = jaccard._between
    monkeypatch.setattr(jaccard, "_between", lambda *a: made.append(between(*a)) or made[-1])
    shared = " ".join(f"s{i}" for i in range(89))
    for m in (20, 40, 80):
        docs = _docs(spark, [f"{shared} " + " ".join(f"o{m}_{i}_{k}" for k in range(15)) for i in range(m)])
        assert jaccard_components(docs).filter("component_id <> doc_id").count() == 0
        assert made.pop().count() == 0


def test_random_sets_against_brute_force(spark):
    r = random.Random(11)
    pools = [[f"w{p}_{i}" for i in range(160)] for p in range(4)]
    texts = []
    for _ in range(150):
        pool = r.choice(pools)
        at, n = r.randrange(20), r.randrange(60, 130)
        words = pool[at : at + n]
        for _ in range(r.randrange(5)):
            words[r.randrange(len(words))] = f"o{r.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {x.doc_id: x.component_id for x in jaccard_components(_docs(spark, texts)).collect()}
    assert got == {i + 1: find(i) + 1 for i in range(len(texts))} and len(set(got.values())) < len(texts)


def test_cells_grow_in_proportion():
    for each in (400, 1000):
        cells = [dealt_among(n, each) ** 2 / n for n in (10**6, 10**8, 10**10, 10**12)]
        assert max(cells) < 7 and all(abs(x - 1) < 0.01 for x in cells[1:])


def test_identified_rows(spark):
    rows = [(None, "a")] * 50 + [(None, "b"), (1, "a"), (1, "c"), (2, None), (2, "")]
    out = identified(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "text").collect()
    assert len({(r._doc, r._sub) for r in out}) == len(rows) and all(r._sub >= 0 for r in out)


def test_spread(spark):
    rows = spark.createDataFrame([(i, i % 3 if i < 50 else 9) for i in range(500)], "id long, k long")
    few = spark.createDataFrame([(9, "x"), (9, "y"), (1, "z")], "k long, v string")
    got = spread(rows, few, ["k"], ["id"])
    assert sorted(map(tuple, got.select("id", "k", "v").collect())) == sorted(map(tuple, rows.join(few, "k").select("id", "k", "v").collect()))


@pytest.mark.parametrize("seed", range(2))
def test_hot_grams_go_window_by_window(spark, seed):
    """A passage shorter than a window in very many contexts: its gram has a run of its own in each."""
    r = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = []
    for i in range(60):
        around = [f"c{r.randrange(3)}_{k}" for k in range(60)]
        texts.append(" ".join([*around[:30], passage, *around[30:]]))
    seen, want = {}, {}
    for i, t in enumerate(texts, 1):
        words = t.split()
        gone = [False] * len(words)
        for k in range(len(words) - 49):
            if seen.setdefault(tuple(words[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        want[i] = sum(gone)
    from tallyloom.llm import repeats

    whole, repeats.HOT_RUNS = repeats.HOT_RUNS, 1
    try:
        assert {x.doc_id: x.n_removed for x in cut_repeated_words(_docs(spark, texts)).collect()} == want
    finally:
        repeats.HOT_RUNS = whole


def test_topk_in_many_blocks(spark, monkeypatch):
    from tallyloom.llm import topk

    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 8)
    r = np.random.default_rng(9)
    rows = [(i, (r.normal(size=6) * np.exp(r.normal())).tolist()) for i in range(900)] + [(900, [0.0] * 6), (901, [1e-9] * 6)]
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    found: dict = {}
    for x in topk.query_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), each=25, k=4).orderBy("query_id", "rank").collect():
        found.setdefault(x.query_id, []).append((x.score, x.vec_id))
    for q in range(0, 902, 25):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:4]
        assert found[q] == [(-s, i) for s, i in best]


def _asked(n: int) -> int:
    """Bytes of the segments asked for of n texts that share a phrase, which is shorter than a window."""
    rnd = random.Random(n)
    prose = lambda k: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    texts = pa.array([prose(150) + " a phrase that stands in very many texts " + prose(150) for _ in range(n)])
    docs = pa.table({"_doc": pa.array(range(n), pa.int64()), "_sub": pa.array([0] * n, pa.int64()), "text": texts})
    runs = pa.Table.from_batches(list(repeats._map_runs(BYTES, 1, 1)(iter(docs.to_batches()))))
    met = repeats._meet_runs(BYTES, 1)(runs)
    dealt = repeats._segments(BYTES, 1, 1)(docs, met)
    return sum(repeats.unpacked(dealt["data"].to_pylist(), repeats.SEGMENT)[0][4].tolist())


def test_a_common_phrase_asks_for_no_texts():
    assert _asked(100) == _asked(3000) == 0  # as many windows as there are texts shared a gram, and beyond HOT_RUNS went one by one
