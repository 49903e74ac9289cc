"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word gives two kinds of input: an embedding of the word, and its spelling, the mean
of embeddings of all runs of three bytes of the word with its edges marked, so that
inflected, compounded and altered forms share most of it.  Both directions of the network run over windows of 32 words, an attention layer pools
the states of a window, and the pooled state gives its logit.  Windows overlap by
half in training and by three quarters in scoring, so a passage of up to 25 words lies
whole in one, and a text is as toxic as its worst window.

Labels are of texts, not of windows.  Training takes the windows that score highest
in toxic texts as positive, the highest and some random ones of clean texts as
negative, and chooses anew in each epoch; the first choice is by what single
words tell, which also starts the embeddings and selects the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textcols import ALNUM, Texts, Words, chunks, mix64, ranges, texts_of

#: Words of a window; words from one to the next in training, and in scoring.
WINDOW, STRIDE, SCORED_STRIDE = 32, 16, 8
#: Width of an embedding, and of the state of a direction.
WIDTH, STATE = 8, 8
#: Training documents of each label at most; the sample is drawn by a hash of doc_id.
SAMPLE_DOCS = 1500
#: Bytes of the longest text among them.
SAMPLE_BYTES = 32_768
#: Known words and known runs of three bytes, at most; others are one unknown word, one unknown run.
VOCABULARY, CHARACTERS = 16_384, 8_192
#: Slots of the tables that find them.
SLOTS = 1 << 19
EPOCHS, BATCH, RATE = 8, 256, 0.01
#: Words that tell less aren't in the vocabulary; those that tell so much start with a full hint.
LEAST_ROOT, FULL_ROOT = 3.5, 10.0
#: Share of a batch's inputs shown as unknown, and the tables' share of the rate: both keep words from being learnt by heart.
HIDDEN, SLOWER = 0.1, 0.1
#: Steps of training at least: a small sample is gone through more often, in smaller batches.
STEPS = 300
#: Windows scored at once.
BLOCK = 1024


def held_out() -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _spelled(texts: Texts, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of three bytes of the words `at`, edges marked, as numbers, and where each word's begin."""
    size = words.end[at] - words.start[at]
    begin = np.cumsum(size + 2) - (size + 2)
    marked = np.full(int((size + 2).sum()), 2, np.uint32)
    marked[begin + size + 1] = 3
    marked[ranges(begin + 1, size)] = texts.data[ranges(words.start[at], size)]
    runs = ranges(begin, size)
    return marked[runs] | marked[runs + 1] << np.uint32(8) | marked[runs + 2] << np.uint32(16), np.concatenate([[0], np.cumsum(size)])


def _run_keys(runs: np.ndarray) -> np.ndarray:
    return mix64(runs.astype(np.uint64) + np.uint64(1 << 40), own=True)


@dataclass
class Spelling:
    """Known runs of a chunk's different words: word j (from 1; 0 is none) has of[first[j]:first[j + 1]]."""

    first: np.ndarray
    of: np.ndarray

    def runs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of the words, one after the other, and how many each has."""
        n = self.first[which + 1] - self.first[which]
        return self.of[ranges(self.first[which], n)], n

    def means(self, table: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The mean of the table's rows over each word's runs; zeros for none."""
        out = np.zeros((len(which), table.shape[1]), table.dtype)
        for lo in range(0, len(which), 1 << 13):
            of, n = self.runs(which[lo : lo + (1 << 13)])
            some = np.flatnonzero(n)
            if len(some):
                out[lo + some] = np.add.reduceat(table[of], (np.cumsum(n) - n)[some], axis=0) / n[some, None].astype(table.dtype)
        return out

    @staticmethod
    def joined(parts: list[Spelling]) -> Spelling:
        """All parts' words, one part after the other; the next part's numbers go on from the last one's."""
        lengths = np.concatenate([[0], *(np.diff(p.first[1:]) for p in parts)]).astype(np.int64)
        return Spelling(np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([p.of for p in parts]))

    def __len__(self) -> int:
        return len(self.first) - 2


class Lookup:
    """Numbers of known 64-bit keys, from 2; 0 is padding and 1 is any other key."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys  # the most important first: of keys that share a slot, it stays
        slots = (keys % np.uint64(SLOTS)).astype(np.int64)
        self.held, self.number = np.zeros(SLOTS, np.uint64), np.ones(SLOTS, np.int32)
        self.held[slots[::-1]] = keys[::-1]
        self.number[slots[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32) + 2

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slots = (keys % np.uint64(SLOTS)).astype(np.int64)
        return np.where(self.held[slots] == keys, self.number[slots], 1)

    def __reduce__(self):
        return Lookup, (self.keys,)


def windows_of(texts: Texts, lookups: list[Lookup], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, Spelling]:
    """All windows of the texts: their rows, the numbers of their words (2, windows, WINDOW: in the vocabulary, and among the chunk's
    different words), which are words, and the different words' spelling.

    Windows start at every stride-th word, the last one ends with the text; a shorter
    text is one window with padding.
    """
    low = texts.lowered()
    words = Words(low, ALNUM)
    hashes = words.hashes()
    _, example, nth_word = np.unique(hashes, return_index=True, return_inverse=True)
    keys, first = _spelled(low, words, example)
    n = words.counts()
    per = np.maximum(1, -(-(n - WINDOW) // stride) + 1)
    row = np.repeat(np.arange(len(texts)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = np.minimum(nth * stride, np.maximum(n - WINDOW, 0)[row])
    real = start[:, None] + np.arange(WINDOW) < n[row][:, None]
    at = np.where(real, (words.first[row] + start)[:, None].astype(np.int32) + np.arange(WINDOW, dtype=np.int32), 0)
    numbers = np.zeros((2, *at.shape), np.int32)
    for out, found in zip(numbers, (lookups[0](hashes), nth_word.astype(np.int32) + 1), strict=True):
        if len(found):
            out[:] = np.where(real, found[at], 0)
    return row, numbers, real, Spelling(np.concatenate([[0], first]).astype(np.int64), lookups[1](_run_keys(keys)).astype(np.int16))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


#: Gates update, reset, candidate; in each, the forward state's places and then the backward one's.
_BOTH = 2 * STATE


def _block_mask() -> np.ndarray:
    """Keeps the directions apart in the recurrent weights."""
    one = np.kron(np.eye(2, dtype=np.float32), np.ones((STATE, STATE), np.float32))
    return np.tile(one, (1, 3))


@dataclass
class Network:
    """Parameters: tables of words and of runs of bytes, input and recurrent weights, attention, output."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, sizes: list[int], rng: np.random.Generator) -> Network:
        f = lambda *shape, scale=0.3: rng.normal(0, scale, shape).astype(np.float32)
        p = {f"table{i}": f(n, WIDTH, scale=0.02) for i, n in enumerate(sizes)}
        p |= {"input": f(2 * WIDTH, 3 * _BOTH), "bias": np.zeros(3 * _BOTH, np.float32), "recurrent": f(_BOTH, 3 * _BOTH) * _block_mask()}
        p |= {"attend": f(_BOTH, STATE), "attend_bias": np.zeros(STATE, np.float32), "query": f(STATE), "out": f(_BOTH), "out_bias": np.zeros(1, np.float32)}
        return cls(p)

    def embedded(self, numbers: np.ndarray, spelling: Spelling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of all words (WINDOW, windows, 2 tables), the different words among them, and which of these each is."""
        different, which = np.unique(numbers[1].T, return_inverse=True)
        spelled = spelling.means(self.p["table1"], different)
        return np.concatenate([self.p["table0"][numbers[0].T], spelled[which.reshape(numbers[1].T.shape)]], axis=2), different, which.reshape(-1)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """(WINDOW, windows, 3 gates): the backward places read the window from its end."""
        return self._turned(x.reshape(-1, 2 * WIDTH) @ self.p["input"] + self.p["bias"], x.shape[:2])

    @staticmethod
    def _turned(g: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        g = g.reshape(*shape, 3, 2, STATE)
        out = g.copy()
        out[:, :, :, 1] = g[::-1, :, :, 1]
        return out.reshape(*shape, 3 * _BOTH)

    def forward(self, x: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; keep receives what backward needs."""
        p = self.p
        steps, n, _ = x.shape
        h, states = np.zeros((n, _BOTH), np.float32), np.empty((steps, n, _BOTH), np.float32)
        trail = []
        for t in range(steps):
            a = h @ p["recurrent"]
            gates = _sigmoid(x[t, :, : 2 * _BOTH] + a[:, : 2 * _BOTH])
            z, r, b = gates[:, :_BOTH], gates[:, _BOTH:], a[:, 2 * _BOTH :]
            c = np.tanh(x[t, :, 2 * _BOTH :] + r * b)
            if keep is not None:
                trail.append((h, z, r, b, c))
            h = c + z * (h - c)
            states[t, :, :STATE] = h[:, :STATE]
            states[steps - 1 - t, :, STATE:] = h[:, STATE:]
        u = np.tanh(states.reshape(-1, _BOTH) @ p["attend"] + p["attend_bias"])
        e = (u @ p["query"]).reshape(steps, n)
        seen = np.where(real.any(axis=1)[:, None], real, True).T
        e = np.where(seen, e, np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = (w[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep.update(trail=trail, states=states, u=u, w=w, pooled=pooled)
        return pooled @ p["out"] + p["out_bias"][0]

    def gradients(self, numbers: np.ndarray, real: np.ndarray, target: np.ndarray, spelling: Spelling) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of windows and its gradients."""
        p, k = self.p, {}
        given, different, which = self.embedded(numbers, spelling)
        x = self.inputs(given)
        logit = self.forward(x, real, k)
        prob = 1 / (1 + np.exp(-logit))
        loss = float(np.mean(np.logaddexp(0, logit) - target * logit))
        steps, n, _ = x.shape
        states, u, w = k["states"], k["u"], k["w"]
        d = ((prob - target) / n).astype(np.float32)
        g = {"out": k["pooled"].T @ d, "out_bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["out"]
        d_states = w[:, :, None] * d_pooled
        d_w = (states * d_pooled).sum(axis=2)
        d_e = (w * (d_w - (w * d_w).sum(axis=0))).reshape(-1)
        g["query"] = u.T @ d_e
        d_u = d_e[:, None] * p["query"] * (1 - u * u)
        g["attend"], g["attend_bias"] = states.reshape(-1, _BOTH).T @ d_u, d_u.sum(axis=0)
        d_states = d_states + (d_u @ p["attend"].T).reshape(states.shape)
        d_x, d_h = np.empty_like(x), np.zeros((n, _BOTH), np.float32)
        g["recurrent"] = np.zeros_like(p["recurrent"])
        for t in range(steps - 1, -1, -1):
            h, z, r, b, c = k["trail"][t]
            d_h[:, :STATE] += d_states[t, :, :STATE]
            d_h[:, STATE:] += d_states[steps - 1 - t, :, STATE:]
            d_c = d_h * (1 - z) * (1 - c * c)
            d_z = d_h * (h - c) * z * (1 - z)
            d_r = d_c * b * r * (1 - r)
            d_x[t] = np.concatenate([d_z, d_r, d_c], axis=1)
            d_a = np.concatenate([d_z, d_r, d_c * r], axis=1)
            g["recurrent"] += h.T @ d_a
            d_h = d_h * z + d_a @ p["recurrent"].T
        g["recurrent"] *= _block_mask()
        d_x = self._turned(d_x, (steps, n)).reshape(-1, 3 * _BOTH)
        g["input"], g["bias"] = given.reshape(-1, 2 * WIDTH).T @ d_x, d_x.sum(axis=0)
        d_rows = d_x @ p["input"].T
        g["table0"], g["table1"] = np.zeros_like(p["table0"]), np.zeros_like(p["table1"])
        np.add.at(g["table0"], numbers[0].T.reshape(-1), d_rows[:, :WIDTH])
        d_spelled = np.zeros((len(different), WIDTH), np.float32)
        np.add.at(d_spelled, which, d_rows[:, WIDTH:])
        of, n = spelling.runs(different)
        np.add.at(g["table1"], of, np.repeat(d_spelled / np.maximum(n, 1)[:, None].astype(np.float32), n, axis=0))
        return loss, g

    def folded(self) -> list[np.ndarray]:
        """The tables times their input weights, so that a word's input is a sum of two rows."""
        p = self.p
        return [p["table0"] @ p["input"][:WIDTH] + p["bias"], p["table1"] @ p["input"][WIDTH:]]


@dataclass
class Model:
    """A fitted network with its vocabulary."""

    lookups: list[Lookup]
    network: Network

    def window_scores(self, numbers: np.ndarray, real: np.ndarray, spelling: Spelling) -> np.ndarray:
        words, runs = self.network.folded()
        spelled = spelling.means(runs, np.arange(len(spelling) + 1))
        out = np.empty(numbers.shape[1], np.float32)
        for lo in range(0, len(out), BLOCK):
            own = numbers[:, lo : lo + BLOCK]
            g = words[own[0].T]
            g += spelled[own[1].T]
            out[lo : lo + BLOCK] = self.network.forward(Network._turned(g, g.shape[:2]), real[lo : lo + BLOCK])
        return out

    def scores(self, texts: Texts, stride: int = SCORED_STRIDE) -> np.ndarray:
        """The probability of label 1 for each text: that of its highest window, to 6 digits, as single precision depends on a window's batch."""
        if not len(texts):
            return np.zeros(0)
        row, numbers, real, spelling = windows_of(texts, self.lookups, stride)
        logit = np.full(len(texts), -np.inf)
        np.maximum.at(logit, row, self.window_scores(numbers, real, spelling).astype(float))
        return np.round(1 / (1 + np.exp(-logit)), 6)


def _telling(keys: np.ndarray, row: np.ndarray, toxic: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (once for each text) that tell most about the label, the best first, and how much: signed roots of likelihood ratios."""
    known, of = np.unique(keys, return_inverse=True)
    yes = np.bincount(of, toxic[row], minlength=len(known))
    no = np.bincount(of, minlength=len(known)) - yes
    a, b = toxic.sum(), (1 - toxic).sum()
    share = a / (a + b)  # of toxic texts; the root of the likelihood ratio against it tells chance from signal
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(yes > 0, yes * np.log(yes / ((yes + no) * share)), 0) + np.where(no > 0, no * np.log(no / ((yes + no) * (1 - share))), 0)
    root = np.sqrt(np.maximum(2 * ratio, 0)) * np.sign(yes - (yes + no) * share)
    best = np.argsort(-np.abs(root), kind="stable")[:most]
    best = best[np.abs(root[best]) >= LEAST_ROOT]
    return known[best], root[best]


def fit(texts: Texts, toxic: np.ndarray, seed: int = 7) -> Model | None:
    """The model of labelled texts, or None if a label is missing among them."""
    toxic = toxic.astype(np.float64)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    rng = np.random.default_rng(seed)
    pieces = list(texts.pieces())
    features: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]  # a chunk at a time, as the driver's memory is small
    for begin, own in pieces:
        low = own.lowered()
        words = Words(low, ALNUM)
        hashes = words.hashes()
        one = np.lexsort((hashes, words.row))  # a text's words once each
        new = np.ones(len(one), bool)
        new[1:] = (words.row[one][1:] != words.row[one][:-1]) | (hashes[one][1:] != hashes[one][:-1])
        one = one[new]
        runs, first = _spelled(low, words, one)
        spelled = np.unique(np.repeat(words.row[one] + begin, np.diff(first)) << 24 | runs)  # a text's runs once each
        features[0].append(((words.row[one] + begin).astype(np.int32), hashes[one]))
        features[1].append(((spelled >> 24).astype(np.int32), (spelled & 0xFFFFFF).astype(np.uint32)))
        del words, hashes, one, new, runs, first, spelled
    found = [_telling(np.concatenate([k for _, k in part]), np.concatenate([r for r, _ in part]), toxic, most) for part, most in zip(features, (VOCABULARY, CHARACTERS), strict=True)]
    found[1] = _run_keys(found[1][0]), found[1][1]
    del features
    lookups = [Lookup(keys) for keys, _ in found]
    network = Network.fresh([len(keys) + 2 for keys, _ in found], rng)
    hints = []
    for i, (_, root) in enumerate(found):
        hint = np.concatenate([[0, 0], np.clip(root / FULL_ROOT, -1, 1)]).astype(np.float32)
        network.p[f"table{i}"][:, 0] += hint
        hints.append(hint)
    model = Model(lookups, network)
    parts = [(begin, windows_of(own, lookups)) for begin, own in pieces]
    row = np.concatenate([r + begin for begin, (r, _, _, _) in parts])
    spelling = Spelling.joined([x for _, (_, _, _, x) in parts])
    before = np.cumsum([0, *(len(x) for _, (_, _, _, x) in parts)])
    for (_, (_, n, _, _)), more in zip(parts, before, strict=False):
        n[1][n[1] > 0] += more
    numbers, real = np.concatenate([n for _, (_, n, _, _) in parts], axis=1), np.concatenate([x for _, (_, _, x, _) in parts])
    del parts
    first, second = ({k: np.zeros_like(v) for k, v in network.p.items()} for _ in range(2))
    spelled = spelling.means(hints[1][:, None], np.arange(len(spelling) + 1))[:, 0]
    step, score = 0, (hints[0][numbers[0]] + spelled[numbers[1]]).max(axis=1)
    epoch, epochs = 0, EPOCHS
    while epoch < epochs:
        rate = RATE * (1 - epoch / epochs)
        order = np.lexsort((-score, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order], "left")
        label = toxic[row[order]]
        chosen = order[(place == 0) | (label == 0) & ((place == 1) | (rng.random(len(order)) < 0.05))]
        yes = chosen[toxic[row[chosen]] == 1]
        no = chosen[toxic[row[chosen]] == 0]
        chosen = rng.permutation(np.concatenate([np.repeat(yes, max(1, min(8, len(no) // max(1, 2 * len(yes))))), no]))
        each = min(BATCH, max(16, len(chosen) // 8))
        epoch, epochs = epoch + 1, max(epochs, -(-STEPS * each // len(chosen)))
        for lo in range(0, len(chosen), each):
            own = chosen[lo : lo + each]
            shown, hidden = numbers[:, own], rng.random((2, len(own), WINDOW)) < HIDDEN
            shown = np.stack([np.where(hidden[0], np.minimum(shown[0], 1), shown[0]), np.where(hidden[1], 0, shown[1])])
            _, g = network.gradients(shown, real[own], toxic[row[own]].astype(np.float32), spelling)
            step += 1
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                change = rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                network.p[k] -= (change * (SLOWER if k.startswith("table") else 1)).astype(np.float32)
        score = model.window_scores(numbers, real, spelling)
    return model


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of at most SAMPLE_DOCS documents of each label outside the held-out fold, less those of over SAMPLE_BYTES: 98 MB at most."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("_toxic"))
    drawn = [known.filter(F.col("_toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS) for k in (0, 1)]
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES
    return docs.filter(short).select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").orderBy("doc_id", "text").select("text", "_toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model fitted on the sample, which is bounded and so goes to the driver."""
    sample = training_sample(docs, labels).toArrow()
    return fit(texts_of(sample["text"]), sample["_toxic"].to_numpy())


def score_documents(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """Every row of docs: doc_id, held_out, score, predicted, and the columns named in keep (as _row).

    All windows of the whole text are scored; a null or empty text is one window of
    padding.  Without labels of both kinds all scores are 0.  Labels that are null or
    belong to no document are not used, and of labels of one document the largest
    counts.  No rows give no rows; equal rows each give theirs.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            score = model.scores(texts) if model else np.zeros(len(texts))
            at = rows.schema.get_field_index("text")
            others = [i for i in range(rows.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in others), pa.array(score.astype(float))], [*(rows.schema.names[i] for i in others), "score"])

    row = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row")] if keep else []
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), *row, "text")
    kept = given.drop("text").schema
    return given.mapInArrow(run, kept.add("score", "double")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't predict to be toxic."""
    scored = score_documents(docs, labels, *docs.columns).filter(F.col("predicted") == 0)
    return scored.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
