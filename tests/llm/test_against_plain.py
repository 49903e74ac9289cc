"""Operators and stages against plain loops: packing, network, license phrases, BPE digests, the pipeline stage by stage."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm.bpe import bpe_digests, vocabulary
from tallyloom.llm.licenses import scan_licenses
from tallyloom.llm.lm import lm_scores
from tallyloom.llm.packing import pack, sum_of_squares
from tallyloom.llm.textcols import ALNUM, Words, texts_of
from tallyloom.llm.topk import query_topk
from tallyloom.llm.toxicity import STATE, WIDTH, WINDOW, Model, Network, Spelling, _spelled, fit, keep_clean, score_documents

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _sub string, _row string, score string, part int"


@pytest.mark.parametrize("seed", range(4))
def test_sum_of_squares_rule(seed):
    """Each piece goes where the squared counts of open gaps come out smallest, into the smaller gap of equal ones."""
    r = random.Random(seed)
    capacity = 30
    lengths = [r.randint(1, capacity) for _ in range(300)]
    gaps, want = [], []  # gap of each sequence
    for s in lengths:
        best = None
        for gap in sorted({g for g in gaps if g >= s}):
            after = list(gaps)
            after[after.index(gap)] = gap - s
            squares = sum(after.count(g) ** 2 for g in set(after) if g > 0)
            if best is None or squares < best[0]:
                best = (squares, gap)
        if best is None:
            gaps.append(capacity - s)
            want.append(0)
        else:
            gaps[gaps.index(best[1])] -= s
            want.append(capacity - best[1])
    bins, offsets = sum_of_squares(np.array(lengths), capacity)
    assert offsets.tolist() == want and len(set(bins.tolist())) == len(gaps)
    filled = {}
    for b, o, s in zip(bins.tolist(), offsets.tolist(), lengths, strict=True):
        assert filled.get(b, 0) == o
        filled[b] = o + s


def _network(seed: int):
    rng = np.random.default_rng(seed)
    network = Network.fresh([7, 6], rng)
    for name in ("bias", "attend_bias", "out_bias"):
        network.p[name] = rng.normal(0, 0.3, network.p[name].shape).astype(np.float32)
    for i in range(2):
        network.p[f"table{i}"] *= 20
    spelling = Spelling(np.array([0, 0, 3, 4, 4, 9]), rng.integers(0, 6, 9))  # words 1 to 4; the third has no runs
    numbers = np.stack([rng.integers(0, n, (6, WINDOW)) for n in (7, 5)]).astype(np.int32)
    real = np.arange(WINDOW) < np.array([WINDOW, 20, 3, 1, 0, WINDOW])[:, None]
    return network, np.where(real, numbers, 0).astype(np.int32), real, spelling


def _plain_logit(p: dict, numbers: np.ndarray, real: np.ndarray, spelling: Spelling) -> float:
    """A window's logit, one word and one direction at a time."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def spelled(j):
        runs = spelling.of[spelling.first[j] : spelling.first[j + 1]]
        return sum((p["table1"][r].astype(float) for r in runs), np.zeros(WIDTH)) / max(1, len(runs))

    words = [np.concatenate([p["table0"][numbers[0, t]].astype(float), spelled(numbers[1, t])]) for t in range(WINDOW)]
    weight, recurrent, bias = (p[k].astype(float) for k in ("input", "recurrent", "bias"))
    assert weight.shape[0] == 2 * WIDTH
    states = np.zeros((WINDOW, 2 * STATE))
    for direction in (0, 1):
        cols = [slice(gate * 2 * STATE + direction * STATE, gate * 2 * STATE + (direction + 1) * STATE) for gate in range(3)]
        rows = slice(direction * STATE, (direction + 1) * STATE)
        h = np.zeros(STATE)
        for t in range(WINDOW) if direction == 0 else range(WINDOW - 1, -1, -1):
            x = [words[t] @ weight[:, c] + bias[c] for c in cols]
            a = [h @ recurrent[rows, c] for c in cols]
            z, r = sigmoid(x[0] + a[0]), sigmoid(x[1] + a[1])
            c = np.tanh(x[2] + r * a[2])
            h = z * h + (1 - z) * c
            states[t, rows] = h
    e = np.array([np.tanh(s @ p["attend"] + p["attend_bias"]) @ p["query"] for s in states])
    seen = real if real.any() else np.ones(WINDOW, bool)
    w = np.where(seen, np.exp(e - e[seen].max()), 0)
    return float((w / w.sum()) @ states @ p["out"] + p["out_bias"][0])


def test_network_forward():
    network, numbers, real, spelling = _network(1)
    want = [_plain_logit(network.p, numbers[:, i], real[i], spelling) for i in range(6)]
    assert network.forward(network.inputs(network.embedded(numbers, spelling)[0]), real) == pytest.approx(want, abs=1e-4)
    assert Model([], network).window_scores(numbers, real, spelling) == pytest.approx(want, abs=1e-4)


def test_network_gradients():
    network, numbers, real, spelling = _network(2)
    target = np.array([1, 0, 1, 0, 1, 0], np.float32)
    _, gradients = network.gradients(numbers, real, target, spelling)
    rng, checked = np.random.default_rng(3), 0

    def loss(p):
        logits = np.array([_plain_logit(p, numbers[:, i], real[i], spelling) for i in range(6)])
        return float(np.mean(np.logaddexp(0, logits) - target * logits))

    for name, g in gradients.items():
        flat = np.flatnonzero(np.abs(g.ravel()) > 1e-4)
        for at in rng.permutation(flat)[:4]:
            moved = []
            for step in (1e-4, -1e-4):
                p = {k: v.astype(float) for k, v in network.p.items()}
                p[name].ravel()[at] += step
                moved.append(loss(p))
            assert (moved[0] - moved[1]) / 2e-4 == pytest.approx(float(g.ravel()[at]), rel=0.02, abs=2e-5), name
            checked += 1
    assert checked > 20


def test_spelling():
    """Every byte of a word enters, and so do its edges."""
    texts = texts_of(pa.array(["Idiots idiotic, x", "", "é idiots"]))
    words = Words(texts.lowered(), ALNUM)
    keys, first = _spelled(texts.lowered(), words, np.arange(len(words)))
    sets = [set(keys[a:b].tolist()) for a, b in zip(first, first[1:], strict=False)]
    marked = ["\2idiots\3", "\2idiotic\3", "\2x\3", "\2é\3", "\2idiots\3"]
    runs = [{m.encode()[k : k + 3] for k in range(len(m.encode()) - 2)} for m in marked]
    assert [len(x) for x in sets] == [len(x) for x in runs]
    assert all(len(sets[i] & sets[j]) == len(runs[i] & runs[j]) for i in range(5) for j in range(5))


def test_fit_of_one_label_only():
    assert fit(texts_of(pa.array(["a", "b"])), np.array([1, 1])) is None


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    rows = [(i, " ".join("vile" if i % 4 == 0 and k % 25 == 7 else word() for k in range(r.randint(30, 90)))) for i in range(300)]
    rows += [(None, "vile " * 50), (7, rows[7][1]), (7, rows[7][1]), (400, ("calm " * 40000) + "vile " * 30), (401, None), (402, "vile")]
    return rows, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")


def test_toxicity_on_odd_rows(spark, labelled):
    rows, labels = labelled
    docs = spark.createDataFrame([(i, t, "l", "s", 1, "d", "u", "r", "c", 3) for i, t in rows], CLASH)
    got = score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    by_id = {}
    for x in got:
        by_id.setdefault(x.doc_id, []).append(x.score)
    assert len(set(by_id[7])) == 1 and len(by_id[7]) == 3
    assert by_id[None][0] > 0.5 and by_id[400][0] > 0.5  # the last words of a very long text count
    assert not [x for x in got if x.doc_id is None and x.held_out]
    clean = keep_clean(docs, labels)
    assert clean.columns == docs.columns and clean.count() == sum(x.predicted == 0 for x in got)
    none = docs.limit(0)
    assert score_documents(none, labels).count() == 0 and keep_clean(none, labels).count() == 0


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_license_phrases(spark):
    r = random.Random(5)
    parts = ["GNU", "general", "Public", "license", "apache", "Apache License", "cc", "by", "MIT license", "mit", "é", "the", "\n", "cc-by", "x" * 50]
    texts = ["", None, "mit license" * 3, "CC BY", *[" ".join(r.choice(parts) for _ in range(r.choice([3, 30, 300]))) for _ in range(80)], "word " * 60000 + "apache license"]
    got = {x.doc_id: x for x in scan_licenses(spark.createDataFrame([(i, t, 1, "a") for i, t in enumerate(texts)], "doc_id long, text string, labels int, score string")).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
        places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.encode().split()]
        at = [k for k, _ in places]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(words), len(places), min(at, default=None), max(at, default=None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in places})) and set(got[i].base_labels.split(",")) <= {*got[i].labels.split(","), ""}
        assert 0 <= got[i].score <= 1


def test_bpe_digests(spark):
    library, r = Tokenizer.from_file(vocabulary()), random.Random(7)
    parts = ["a", "the,", " ", "\n", "'s", " <|endoftext|>", "é", "日本", "İ", "1", "​", "ﬁ", "🙂", "word ", "it's "]
    texts = ["", None, *["".join(r.choice(parts) for _ in range(r.choice([1, 5, 60]))) for _ in range(60)], "long words repeat " * 3000]
    texts += texts[2:5]
    got = {x.doc_id: x for x in bpe_digests(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_topk_on_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, v string, score int"
    assert query_topk(spark.createDataFrame([], schema)).count() == 0
    rows = [(100, [1.0, 2.0], "a", 1), (100, [1.0, 2.0], "a", 1), (1, [3.0, 0.0], "b", 2), (1, [3.0, 0.0], "b", 2), (2, [0.0, 1.5], None, None), (None, [9.0, 9.0], "n", 0), (200, None, "z", 0)]
    got = [(x.query_id, x.rank, x.vec_id, x.score) for x in query_topk(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == [(100, 1, 1, 3072 * 1024), (100, 2, 1, 3072 * 1024), (100, 3, 2, 1536 * 2048)]


def test_scores_of_odd_rows(spark):
    rows = [(1, "a b c " * 30000), (2, "a b c a"), (2, "a b c a"), (None, "a b"), (3, None), (4, "z")]
    got = lm_scores(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, others string")).collect()
    assert len(got) == len(rows) and sorted(x.n_words for x in got) == [0, 1, 2, 4, 4, 90000]
    assert len({x.log_score for x in got if x.doc_id == 2}) == 1


def _normal(t):
    return re.sub("[ \t-\r]+", " ", t or "")


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's own input against loops; columns that clash stay as they are."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = some(60)
    texts = {i: some(r.randint(20, 150)) for i in range(200)}
    for i in range(100, 120):
        texts[i] = texts[i - 100].replace(" ", "  ")
    for i in range(120, 130):
        texts[i] = texts[i - 100] + " tail"
    for i in range(130, 140):
        texts[i] = f"{some(20)} {shared} {some(20)}"
    for i in range(0, 200, 10):
        texts[i] += " vile vile horrid vile"
    texts[198], texts[199] = "", None
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "d", "u", "r", "c", 3) for i, t in texts.items()], CLASH)
    spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(198)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, at = dict(corpus_pipeline.STAGES), str(tmp_path)

    kept = stages["toxicity"](spark, docs, at)
    ids = {x.doc_id for x in kept.collect()}
    assert kept.columns == docs.columns and {i for i in ids if i % 10} == {i for i in texts if i % 10} and len(ids) < len(texts)

    first = {}
    for i in sorted(texts):
        first.setdefault(_normal(texts[i]), i)
    unique = stages["exact dedup"](spark, docs, at)
    assert sorted(x.doc_id for x in unique.collect()) == sorted(first.values()) and unique.columns == docs.columns

    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()} for i, w in ((i, (t or "").lower().split()) for i, t in texts.items())}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in range(i):
            if grams[i] and 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    near = stages["n-gram Jaccard join"](spark, docs, at)
    assert sorted(x.doc_id for x in near.collect()) == sorted({find(i) for i in texts}) and near.columns == docs.columns

    seen, left = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(raw[k : k + 100])
        left[i] = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    cut = stages["suffix-array dedup"](spark, docs, at)
    assert {x.doc_id: x.text for x in cut.collect()} == left and cut.columns == docs.columns

    library = Tokenizer.from_file(vocabulary())
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    for x in stages["best-fit packing"](spark, docs, at).collect():
        own = ids[x.doc_id][x.start : x.start + x.length]
        assert len(own) == x.length and zlib.crc32(np.array(own, "<u4").tobytes()) == x.ids_crc32
    none = docs.limit(0)
    assert all(stage(spark, none, at).count() == 0 for stage in stages.values())


def test_packing_of_odd_rows(spark):
    rows = [(1, "a " * 9000, "x", 1), (1, "a", "x", 1), (1, "a", "x", 1), (None, None, "y", 2), (2, "", None, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, piece string, length int")).collect()
    assert len(got) == 7 and sum(x.length for x in got if x.doc_id is None) == 1
    places = {}
    for x in got:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))]
