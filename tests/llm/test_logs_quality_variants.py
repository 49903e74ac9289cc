"""Transaction logs, quality and spelling variants against plain replays, loops and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import ordered, quality, undo_log
from tallyloom.llm.quality import quality_scores
from tallyloom.llm.textcols import texts_of
from tallyloom.llm.undo_log import transaction_log
from tallyloom.llm.variants import spelling_variants

DOCS = "doc_id long, text string, source string, key string, seq int"
LABELS = "doc_id long, quality int, toxic int"
SMALL = "/root/testdata/sf0.01"


def _none_first(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


# ---------------------------------------------------------------- sums over what stands before


@pytest.mark.parametrize("by", [[], ["k"]])
def test_preceding_against_loop(spark, monkeypatch, by):
    monkeypatch.setattr(ordered, "BITS", 2)
    r = random.Random(2)
    rows = [(r.choice("ab"), p, r.choice([None, 1, 5, 7])) for p in sorted(r.sample(range(-3000, 3000), 150))]
    df = spark.createDataFrame(rows, "k string, p long, v long").withColumns({"lo": F.col("v"), "hi": F.struct("v", "p")}).repartition(3)
    got = {tuple(x) for x in ordered.preceding(df, by, "p", v="sum", lo="min", hi="max").select("k", "p", "v_before", "lo_before", "hi_before.p").collect()}
    want = set()
    for k, p, _ in rows:
        before = [(q, v) for j, q, v in rows if q < p and (not by or j == k)]
        given = [v for _, v in before if v is not None]
        last = max(((v is not None, v or 0, q) for q, v in before), default=(None, None, None))
        want.add((k, p, sum(given), min(given, default=None), last[2]))
    assert got == want


# ---------------------------------------------------------------- transaction logs


def _plain_replay(rows):
    """rows (seq, stream, op, key, value) in one pass: fates {seq: (fate, by)} and the store after each commit."""
    fates, open_, store, after = {}, defaultdict(lambda: [[], 0]), {}, []
    for seq, stream, op, key, value in sorted(rows, key=lambda r: r[0]):
        state = open_[stream]
        if op in ("put", "delete"):
            state[0].append((seq, op, key, value))
        elif op == "savepoint":
            state[1] = len(state[0])
        elif op == "rollback":
            for c in state[0][state[1] :]:
                fates[c[0]] = ("rollback", seq)
            del state[0][state[1] :]
        else:
            for c in state[0]:
                fates[c[0]] = (op, seq)
                if op == "commit":
                    store.pop(c[2], None)
                    if c[1] == "put":
                        store[c[2]] = c[3]
            open_[stream] = [[], 0]
            if op == "commit":
                after.append(dict(store))
    for state in open_.values():
        for c in state[0]:
            fates[c[0]] = ("abort", None)
    return fates, after


@pytest.mark.parametrize("seed", range(3))
def test_replay_against_plain(spark, monkeypatch, seed):
    monkeypatch.setattr(undo_log, "BLOCK_BITS", 3)
    monkeypatch.setattr(undo_log, "EPOCH_COMMITS", 3)
    monkeypatch.setattr(ordered, "BITS", 2)
    r = random.Random(seed)
    ops = ["put"] * 6 + ["delete", "savepoint", "rollback", "commit"] + ["abort"] * (seed > 0)
    rows = []
    for seq in sorted(r.sample(range(-400, 1600), 500)):
        stream, op = r.choice(["a", "a", "a", "-", None, ""]), r.choice(ops) if seq < 1200 or seed else "put"
        rows.append((seq, stream, op, *((r.choice("xyzw"), None if op == "delete" else f"text {seq}") if op in ("put", "delete") else (None, None))))
    log = spark.createDataFrame(rows + rows[:40], "seq long, stream string, op string, key string, value string").repartition(5)
    steps = undo_log.replayed(log)
    fates, after = _plain_replay(rows)
    changed = undo_log.changes(steps)
    assert {x.seq: (x.fate, x.by) for x in changed.collect()} == fates
    assert {(x.seq, x.stream, x.op, x.key, x.value) for x in changed.collect()} == {x for x in rows if x[2] in ("put", "delete")}
    epochs = undo_log.commits(steps)
    held = defaultdict(dict)
    version = undo_log.versions(changed, epochs)
    for x in sorted(version.collect(), key=lambda x: x.epoch):
        held[x.epoch][x.key] = x.value if x.live else None
    store = {}
    for e, want in enumerate([*after[2::3], *(after[-1:] if len(after) % 3 else [])], 1):
        store.update(held[e])
        assert {k: v for k, v in store.items() if v is not None} == want
    states = {x.epoch: (x.stored, x.total) for x in undo_log.states(version, epochs, F.length("value"), F.length("value_before")).collect()}
    assert states == {e: (len(s), sum(map(len, s.values()))) for e, s in enumerate([*after[2::3], *(after[-1:] if len(after) % 3 else [])], 1)}


def test_long_transaction(spark, monkeypatch):
    """One transaction over many blocks: changes before the savepoint stay, those after it go with the rollback."""
    monkeypatch.setattr(undo_log, "BLOCK_BITS", 2)
    rows = [(i, "s", "put", str(i), "v") for i in range(40)]
    rows[10], rows[30], rows[39] = (10, "s", "savepoint", None, None), (30, "s", "rollback", None, None), (39, "s", "commit", None, None)
    got = {x.seq: (x.fate, x.by) for x in undo_log.changes(undo_log.replayed(spark.createDataFrame(rows, "seq long, stream string, op string, key string, value string"))).collect()}
    assert got == {i: ("rollback", 30) if 10 < i < 30 else ("commit", 39) for i in range(39) if i not in (10, 30)}


def _plain_documents(docs, toxic):
    """The contract, record by record."""
    rows = []
    for i, text, source in docs:
        h = zlib.crc32(str(i).encode())
        m = h % 17
        op = "commit" if m <= 1 else "abort" if m == 2 else "savepoint" if m <= 4 else "rollback" if m <= 6 else "delete" if text is None or i in toxic else "put"
        rows.append((i, source, op, h // 100 % 30000, text))
    fates, after = _plain_replay(rows)
    of = {r[0]: r[3] for r in rows}
    out = [(fate, i, by, of[i]) for i, (fate, by) in fates.items() if fate != "commit"]
    for e, s in enumerate([*after[63::64], *(after[-1:] if len(after) % 64 else [])], 1):
        out.append(("state", e, len(s), sum(zlib.crc32(f"{k}:{t}".encode()) for k, t in s.items())))
    return out


def test_transaction_log_of_documents(spark):
    r = random.Random(9)
    docs = [(i, r.choice([None, "", "ä text", "x" * 5000, f"text {i}"]), r.choice([None, "a", "a", "b"])) for i in r.sample(range(10_000_000), 3000)]
    labels = [(i, 1, 1) for i, _, _ in docs[:200]] + [(docs[5][0], 0, 0), (None, 1, 1), (-7, 1, 1), (docs[300][0], None, None)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs + docs[:50]] + [(None, "t", "a", "clash", 1)], DOCS).repartition(4)
    got = [tuple(x) for x in transaction_log(df, spark.createDataFrame(labels, LABELS)).select("kind", "id", "n", "value").collect()]
    assert _none_first(got) == _none_first(_plain_documents(docs, {i for i, _, _ in docs[:200]}))


def test_transaction_log_without_rows(spark):
    no_docs, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert transaction_log(no_docs, no_labels).count() == 0


# ---------------------------------------------------------------- quality


def test_ftrl_against_loop():
    """Updates of places one by one, as the proximal rule states them."""
    r = random.Random(3)
    model, z, n = quality.Ftrl(12), [0.0] * 12, [0.0] * 12
    weight = lambda i: 0.0 if abs(z[i]) <= quality.L1 else (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    for _ in range(200):
        x = {i: r.random() for i in r.sample(range(12), 4)}
        label = float(3 in x)
        twice = next(iter(x))  # a place that comes twice counts as its sum
        model.learn(np.array([*x, twice]), np.array([*(v - (0.1 if i == twice else 0) for i, v in x.items()), 0.1]), label)
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            z[i], n[i] = z[i] + g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * weight(i), n[i] + g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    assert np.allclose(model.weights(), [weight(i) for i in range(12)])


def test_features_follow_words():
    """Equal texts have equal features wherever they stand; each family has length 1; order and copies tell."""
    texts = ["a b c", "", "A!! b c\n9x", "c b a", "a a a", None, "a b c"]
    first, place, value = quality.features(texts_of(pa.array(texts)))
    row = lambda i: sorted(zip(place[first[i] : first[i + 1]].tolist(), np.round(value[first[i] : first[i + 1]], 9).tolist(), strict=True))
    assert row(0) == row(6) and row(1) == row(5) == [(1 << quality.BITS, 1.0)]
    assert len({str(row(i)) for i in (0, 1, 2, 3, 4)}) == 5
    assert round(sum(v * v for _, v in row(2)), 6) == 7  # six families and the common place
    alone = quality.features(texts_of(pa.array(texts[2:3])))
    assert sorted(zip(alone[1].tolist(), np.round(alone[2], 9).tolist(), strict=True)) == row(2)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_scores(docs, labels)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    told = scored.join(labels, "doc_id").filter("held_out").collect()
    right = [r.predicted == r.quality for r in told]
    assert sum(right) / len(right) >= 0.96
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored.collect())


def test_quality_ignores_labels_held_out(spark):
    """Turning the held-out fold's labels round changes nothing."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet").filter("doc_id < 200") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(quality_scores(docs, labels)) == rows(quality_scores(docs, turned))


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "k", 1), (1, "a b c", "s", "k", 1), (2, None, None, None, None), (None, "", None, None, None), (3, "x" * 30000, "s", "k", 1)], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 1), (9, 0, 0), (3, None, 1)], LABELS)
    got = quality_scores(docs, labels).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert {r.score for r in quality_scores(docs, labels.filter("false")).collect()} == {0.0}
    assert quality_scores(docs.filter("false"), labels).count() == 0


# ---------------------------------------------------------------- spelling variants


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain_variants(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if v != w and _near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_variants_against_brute_force(spark):
    r = random.Random(4)
    stems = ["".join(r.choice("abcé") for _ in range(r.randint(5, 8))) for _ in range(25)]
    grown = list(stems)
    for s in stems * 12:
        at = r.randrange(len(s))
        grown.append(r.choice([s[:at] + s[at + 1 :], s[:at] + r.choice("abcÿ") + s[at:], s[:at] + r.choice("abcé") + s[at + 1 :]]))
    docs = []
    for i in range(400):
        picked = [r.choice(grown[: r.choice([3, 30, 320])]) for _ in range(60)]
        docs.append((i * 7, r.choice([" ", ", ", "9"]).join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in picked)))
    docs += [(None, "x" * 400 + " " + "x" * 401 + " Éclair÷s×"), (3, None), (4, ""), (5, "aaaaaa aaaaaaa aaaaab")] * 6
    docs += [(i + 10**6, "kokoko " * 30 + "kokokm " * 5 + ("kokomm" if i < 6 else "")) for i in range(8)]  # a chain of forms
    df = spark.createDataFrame([(*d, "s", "clash", 1) for d in docs], DOCS).repartition(5)
    got = [tuple(x) for x in spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = _plain_variants(docs)
    assert any(w[1] and w[1] != w[2] for w in want) and any(w[0] == "x" * 400 for w in want)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_variants_of_a_very_long_word(spark):
    """20,000 letters, whose deletions would fill 400 MB in one row."""
    r = random.Random(6)
    long = "".join(r.choice("ab") for _ in range(20_000))
    df = spark.createDataFrame([(i, f"{long} {long[1:]} {long} {long} {long} {long}") for i in range(7)], "doc_id long, text string")
    got = sorted((len(x.word), len(x.form or ""), len(x.root), x.n, x.n_near) for x in spelling_variants(df).collect())
    assert got == [(19_999, 20_000, 20_000, 7, 1), (20_000, 0, 20_000, 35, 1)]


def test_variants_without_rows(spark):
    assert spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).count() == 0
