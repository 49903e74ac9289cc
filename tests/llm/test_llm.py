"""Operators of the llm subpackage against brute force, on small and odd inputs."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import repeats, suffix_tree
from tallyloom.llm.bpe import Encoder, bpe_round_trip, vocabulary
from tallyloom.llm.components import components
from tallyloom.llm.exact_dedup import PerfectHash, exact_dedup, keep_first
from tallyloom.llm.jaccard import jaccard_components, keep_one_of_each
from tallyloom.llm.licenses import Automaton, scan_licenses
from tallyloom.llm.lm import lm_scores
from tallyloom.llm.packing import pack, sum_of_squares
from tallyloom.llm.suffix_array import cut_repeated_bytes, suffix_array, without_repeats
from tallyloom.llm.suffix_tree import cut_repeated_words
from tallyloom.llm.topk import query_topk
from tallyloom.llm.textcols import ALNUM, Words, texts_of
from tallyloom.llm.toxicity import keep_clean, score_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, part int"


def _texts() -> list[tuple]:
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, long = some(70), some(3000)
    out = ["", None, "   ", "one", "a b c", "A b\tC", "a  b c", long, long, long[:9000], "x" * 400, "ab" * 300]
    out += [f"{some(20)} {passage} {some(r.randint(0, 30))}" for _ in range(15)]
    base = some(120).split()
    for _ in range(20):
        edited = list(base)
        for _ in range(r.randint(0, 5)):
            edited[r.randrange(120)] = r.choice(words)
        out.append(" ".join(edited))
    out += [some(r.randint(1, 200)) for _ in range(20)]
    return out


@pytest.fixture(scope="module")
def texts():
    return [(i, t) for i, t in enumerate(_texts())]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in texts]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def twice(spark):
    """Repeated rows, a shared doc_id with different texts, and null ids."""
    return spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "z y x"), (None, "a b c d e f"), (None, None), (2, "q " * 60)], "doc_id long, text string")


OPERATORS = [exact_dedup, cut_repeated_words, cut_repeated_bytes, bpe_round_trip, pack, jaccard_components, lm_scores, scan_licenses]


@pytest.mark.parametrize("operator", OPERATORS)
def test_empty_and_repeated(operator, empty, twice):
    assert operator(empty).count() == 0
    out = operator(twice)
    assert out.count() == twice.count()
    assert out.filter("doc_id is null").count() == 2


def _repeats(texts, split, join, size, earlier):
    seen, out = {}, {}
    for i, t in texts:
        units = split((t or "").encode())
        gone = [False] * len(units)
        for k in range(len(units) - size + 1):
            key = bytes(units[k : k + size]) if isinstance(units, bytes) else tuple(units[k : k + size])
            if earlier(seen.setdefault(key, (i, k)), (i, k)):
                gone[k : k + size] = [True] * size
        out[i] = (len(units), sum(gone), join([u for u, g in zip(units, gone, strict=True) if not g]))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT_RUNS, 2])
def test_repeated_words(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    want = _repeats(texts, bytes.split, b" ".join, 50, lambda a, b: a[0] < b[0])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in cut_repeated_words(docs).collect()}
    assert got == want and sum(x[1] for x in want.values())


@pytest.mark.parametrize("hot", [repeats.HOT_RUNS, 2])
def test_repeated_bytes(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    want = _repeats(texts, bytes, bytes, 100, lambda a, b: a < b)
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in cut_repeated_bytes(docs).collect()}
    assert got == want
    cut = {r.doc_id: r for r in without_repeats(docs).collect()}
    assert {i: r.text for i, r in cut.items()} == {i: x[2].decode("utf-8", "ignore") for i, x in want.items()}
    assert all(r.n_chars == len(r.text) and r._doc == "clash" for r in cut.values())


def test_suffix_array():
    r = np.random.default_rng(0)
    for _ in range(300):
        codes = r.integers(1, r.integers(2, 6), r.integers(0, 50))
        assert suffix_array(codes).tolist() == sorted(range(len(codes)), key=lambda i: codes[i:].tolist())


def test_prefix_sets():
    r = np.random.default_rng(1)
    codes = r.integers(0, 2, 500)
    at = np.arange(400)
    prefix = lambda i, n: tuple(codes[i : i + n].tolist())
    seen = {}
    for own, node, depth in suffix_tree.prefix_sets(codes, at, 50, 40):
        assert len(own) <= 40 or depth == 50
        for i, n in zip(own.tolist(), node.tolist(), strict=True):
            seen[i] = prefix(i, depth)
            assert seen[i] == prefix(own[node == n][0], depth)
    assert len(seen) >= 398


def test_exact_dedup(docs, texts):
    norm = lambda t: " ".join((t or "").replace("\t", " ").split(" ")) if not (t or "").strip() else __import__("re").sub("[ \t-\r]+", " ", t or "")
    norm = lambda t: __import__("re").sub("[ \t-\r]+", " ", t or "")
    groups = {}
    for i, t in texts:
        groups.setdefault(norm(t), []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs).collect()}
    assert got == {i: (groups[norm(t)][0], len(groups[norm(t)]), groups[norm(t)][0] == i, sha256(norm(t).encode()).hexdigest()) for i, t in texts}
    assert sorted(r.doc_id for r in keep_first(docs).collect()) == sorted(g[0] for g in groups.values())


def test_perfect_hash():
    digests = [sha256(bytes([i, j])).digest() for i in range(20) for j in range(50)]
    assert sorted(PerfectHash.build(digests).slots(digests).tolist()) == list(range(1000))
    assert PerfectHash.build([]).slots([]).tolist() == []


def test_jaccard(docs, texts):
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert {r.doc_id for r in keep_one_of_each(docs).collect()} == {find(i) for i in sets}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 110)], "id long")
    got = dict(components(nodes, spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(1, 61)} == {1} and {got[i] for i in (90, 95, 100)} == {90} and got[105] == 105


def test_bpe():
    library = Tokenizer.from_file(vocabulary())
    own, r = Encoder(vocabulary()), random.Random(2)
    parts = ["a", "the,", " ", "\n", "'s", "'", " <|endoftext|>", "<|ENDOFTEXT|>", "é.", "é", "日本", "İ", "Σ", "1", "²", "\x0b", "​", "ﬁ", "🙂", "|", "word "]
    for n in [0, 1, 2, *[40] * 200, 5000]:
        text = "".join(r.choice(parts) for _ in range(n))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_packing(docs, texts):
    library = Tokenizer.from_file(vocabulary())
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    rows = pack(docs, capacity=256).collect()
    taken: dict = {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.start == 256 * r.piece and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in taken.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 256
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))


def test_sum_of_squares():
    bins, offsets = sum_of_squares(np.array([6, 5, 4, 3, 2]), 10)
    assert len(set(bins.tolist())) == 2 and offsets.tolist()[0] == 0


def test_toxicity(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join("vile" if bad and k % 25 == 7 else word() for k in range(r.randint(20, 120)))))
        labels.append((i, int(bad)))
    rows += [(500, ""), (501, None)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in score_documents(docs, known).collect()}
    assert len(got) == 402 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    held = [x for i, x in got.items() if x.held_out and i < 400]
    assert held and all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    assert sum(x.predicted == (x.doc_id % 4 == 0) for x in held) / len(held) > 0.95
    assert keep_clean(docs, known).count() == sum(x.predicted == 0 for x in got.values())
    assert score_documents(docs, known.limit(0)).filter("score <> 0").count() == 0


def test_short_passages_lie_whole_in_a_window(monkeypatch):
    from tallyloom.llm.toxicity import Lookup, Model

    passage = [f"p{i}" for i in range(25)]
    keys = Words(texts_of(pa.array([" ".join(passage)])), ALNUM).hashes()
    monkeypatch.setattr(Model, "window_scores", lambda self, numbers, real, spelling: (numbers[0] > 1).sum(axis=1) - 24.5)
    texts = [" ".join(["x"] * at + passage + ["x"] * (75 - at)) for at in range(76)]
    assert (Model([Lookup(keys)] * 2, None).scores(texts_of(pa.array(texts))) > 0.5).all()


def test_automaton():
    r = random.Random(3)
    for _ in range(100):
        sequences = [[r.randint(0, 3) for _ in range(r.randint(1, 12))] for _ in range(3)]
        words, a = [r.randint(0, 4) for _ in range(30)], Automaton(sequences)
        runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        assert [n for _, n in a.statistics(words)] == [max(k for k in range(i + 2) if not k or tuple(words[i + 1 - k : i + 1]) in runs) for i in range(30)]


def test_licenses(spark):
    from tallyloom.llm.licenses import TEMPLATES

    rows = [(1, "x MIT License; cc by. cc by"), (2, TEMPLATES["bsd"].upper()), (3, None), (4, "mit, the license")]
    got = {x.doc_id: x for x in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 1, 5, "cc-by,mit")
    assert (got[2].base_labels, got[2].labels, got[2].score) == ("", "bsd", 1.0)
    assert got[3].n_words == 0 and got[4].n_base == 0


def test_license_run_that_stands_twice():
    from tallyloom.llm.licenses import TEMPLATES, scanner

    run = "the above copyright notice this list of conditions and the following disclaimer"
    before, between, behind = TEMPLATES["bsd"].split(run)
    a = scanner().automaton
    state, length = a.statistics([scanner().numbers(Words(texts_of(pa.array([run])), ALNUM))[i] for i in range(len(run.split()))])[-1]
    assert length == len(run.split()) and sorted(a.ends[state][3]) == [len((before + run).split()) - 1, len((before + run + between + run).split()) - 1]
    for text in (f"{before} zzz {run}", f"{before} zzz {run} zzz {between}", f"{between} zzz {run}", f"{run} zzz {behind}", f"{between} zzz {run} zzz {behind}"):
        spans = list(scanner().rows(texts_of(pa.array([text]))))[0][-1]
        assert [(x["label"], x["covered"]) for x in spans if x["label"] == "bsd"] == [("bsd", len(text.replace("zzz", "").split()))]


def test_topk(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=8) * r.choice([0.1, 1, 5])).tolist()) for i in range(600)]
    rows += [(600, rows[3][1]), (601, None), (602, [1.0, None]), (603, [float("nan")] * 8), (604, [])]
    vectors = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got = {}
    for x in query_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    for q in range(0, 700, 100):
        if q in vectors:
            best = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:10]  # noqa: B905
            assert got[q] == [(-s, i) for s, i in best]


def test_lm(spark):
    rows = [(1, "a b a b c"), (2, "a b d"), (3, "A B"), (4, "")]
    got = {x.doc_id: x for x in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # document 2: a has 3 others of 7 words; ab 3 of 3; d is unseen and backs off
    assert got[2].n_backoff == 1 and got[2].log_score == pytest.approx(np.log(3 / 7) + np.log(3 / 3) + np.log(0.4) + np.log(0.5 / 7))
    assert got[4].log_score == 0 and got[4].mean_log_score is None


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 100
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
