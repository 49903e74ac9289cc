"""Finding all windows of a corpus that stand earlier already; shared by substring and suffix-array dedup.

A window is W consecutive units (words or bytes) of one document.  Every window
names an anchor: the place inside it of the gram with the smallest hash.  Equal
windows name equal grams at equal places, so dealing windows by their anchor's gram
brings equal ones together, and the windows that share an anchor are one run: a row
for some twenty windows or more.

1. `runs_of` gives each run BLAKE2's 128-bit digest of all its bytes (id), and deals it
   by its gram.  Runs with equal ids are equal throughout; all but the earliest are
   covered.  They are dropped at the map side where a task's rows hold them, the rest
   where they meet.
2. Windows are of one of a few classes, by how far they reach before their gram.  All
   windows of a class hold the same stretch around the gram, some five sixths of a
   window, and a run has a name for each of its classes, a hash of the gram and of
   those at both ends of that stretch (nothing rests on it).  Equal windows are of one class and name, so only names that runs that differ
   share need texts: a common line or phrase shorter than the stretch asks for none.
   The earliest runs ask for the segments of these classes, and each group is searched
   in memory, by a suffix tree or a suffix array over the segments, which compare the
   words or bytes themselves.
3. The segments of a name with very many different runs aren't brought to one task:
   each of its windows is a segment of its own, dealt by the whole window, and
   searched like the others.

What is covered comes back as spans by bucket of documents, where the texts are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.rows import checkpointed, dealt_among, parts, volume
from tallyloom.llm.textcols import Texts, Words, blocks, chunks, combined, paired, ranges, sliding_argmin, texts_of

#: Documents that are cut together, and per group of keys, at least (see rows.dealt_among).
BUCKET_DOCS, GROUP_DOCS = 400, 1000
#: Documents whose runs make a group, at least: few enough for memory, and so many that what goes between groups and buckets is no dust.
RUN_DOCS = 4000
#: Groups beyond which four for each partition, which even out the tasks of small inputs, aren't needed.
GROUPS_EVEN = 256
#: Different runs of one name beyond which its windows are dealt one by one.
HOT_RUNS = 2048
#: Classes of windows by how far they reach before their gram.
CLASSES = 4
#: Runs that a task deals at once, for each group, and at most.
RUNS_EACH, RUNS_MOST = 256, 1 << 19

RUN = ("<u8", "<u8", "<i8", "<i8", "<i4", "<u2", "<u2", *["<u4"] * CLASSES)  # id, rest of id, doc, sub, start, run, gram's place in the first window, names
SPAN = ("<i8", "<i8", "<i4", "<i4")  # doc, sub, start, end
WISH = ("<i4", "<i8", "<i8", "<i4", "<i4", "<i4")  # part, doc, sub, start, run, hot
SEGMENT = ("<i8", "<i8", "<i4", "<i4", "<i4")  # doc, sub, start, run, bytes
DEALT = "part int, kind int, data binary"
RUNS, SPANS, WISHES, SEGMENTS = range(4)


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)  # making one takes longer than packing a few rows


def packed(columns: list[np.ndarray], kinds: tuple[str, ...], tail: bytes = b"") -> bytes:
    raw = b"".join([np.int64(len(columns[0])).tobytes(), *(np.ascontiguousarray(c, k).tobytes() for c, k in zip(columns, kinds, strict=True)), tail])
    return _compressor().compress(raw)


def unpacked(blobs: list[bytes], kinds: tuple[str, ...]) -> tuple[list[np.ndarray], bytes]:
    """The columns of all blobs, and their tails, in turn."""
    columns: list[list[memoryview]] = [[] for _ in kinds]
    widths, tails, open_blob = [np.dtype(k).itemsize for k in kinds], [], zstandard.ZstdDecompressor()
    for blob in blobs:
        raw = memoryview(open_blob.decompress(blob))
        n, at = int.from_bytes(raw[:8], "little"), 8
        for out, width in zip(columns, widths, strict=True):
            out.append(raw[at : at + n * width])
            at += n * width
        tails.append(raw[at:])
    return [np.frombuffer(bytearray().join(x), k) if any(map(len, x)) else np.zeros(0, k) for x, k in zip(columns, kinds, strict=True)], b"".join(tails)


def dealt(part: np.ndarray, kind: int, columns: list[np.ndarray], kinds: tuple[str, ...], lengths: np.ndarray | None = None, data: np.ndarray | None = None, begins: np.ndarray | None = None) -> list[tuple[int, int, bytes]]:
    """Rows of DEALT: one for each part; data holds lengths[i] bytes from begins[i] on for entry i, if any."""
    order = np.argsort(part, kind="stable")
    named = part[order]
    edges = np.append(np.flatnonzero(np.diff(named, prepend=-(1 << 62))), len(order))
    parts, edges = named[edges[:-1]].tolist(), edges.tolist()
    raw = [(memoryview(np.ascontiguousarray(c[order], k)).cast("B") if len(order) else b"", np.dtype(k).itemsize) for c, k in zip(columns, kinds, strict=True)]
    if data is not None:
        lengths, begins = lengths[order], begins[order]
    out, pack = [], _compressor().compress
    for own, lo, hi in zip(parts, edges, edges[1:], strict=False):
        tail = b"" if data is None else data[ranges(begins[lo:hi], lengths[lo:hi])].tobytes()
        out.append((own, kind, pack(b"".join([(hi - lo).to_bytes(8, "little"), *(r[lo * width : hi * width] for r, width in raw), tail]))))
    return out


def batch(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"part": pa.array(a, pa.int32()), "kind": pa.array(b, pa.int32()), "data": pa.array(c, pa.binary())})


@dataclass(frozen=True)
class Units:
    """What texts are made of: whole words, or bytes."""

    words: bool
    window: int
    gram: int
    #: Whether a window is covered by equal ones of its own document that start earlier.
    within: bool

    def split(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, Words | None]:
        """Where each unit begins (and the last one ends) in the bytes that digests are of, the first unit of each row, and the words."""
        if self.words:
            words = Words(texts)
            return words.spaced()[1], words.first, words
        return np.arange(len(texts.data) + 1), texts.offsets, None

    def content(self, texts: Texts, words: Words | None) -> np.ndarray:
        """The bytes of all units, one after the other."""
        return texts.data if words is None else words.spaced()[0]

    def grams(self, texts: Texts, words: Words | None) -> np.ndarray:
        """A hash of the gram at each unit; it deals runs, and nothing rests on it."""
        return combined(blocks(texts.data)[:-1].copy(), self.gram // 8, 8)[: len(texts.data) - self.gram + 1] if words is None else combined(words.hashes(), self.gram)


def digests(content: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of BLAKE2's 128-bit digest of content[lo:hi] for each span."""
    data = memoryview(np.ascontiguousarray(content)).cast("B") if len(content) else memoryview(b"")
    both = np.frombuffer(b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


#: Finds, for segments in memory, the windows that an earlier one equals.
Search = Callable[["Units", np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _earliest(ids: tuple[np.ndarray, np.ndarray], doc: np.ndarray, sub: np.ndarray, start: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of ids, and which of them stay: the first of each id, or all of the first document."""
    one, two = ids
    order = np.lexsort((start, sub, doc, one))
    halves = one[order], two[order]
    if ((halves[0][1:] == halves[0][:-1]) & (halves[1][1:] != halves[1][:-1])).any():
        order = np.lexsort((start, sub, doc, two, one))
        halves = one[order], two[order]
    first = np.ones(len(order), bool)
    first[1:] = (halves[0][1:] != halves[0][:-1]) | (halves[1][1:] != halves[1][:-1])
    if within or not len(order):
        return order, first
    d = doc[order]
    return order, d == d[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]


#: Deal documents to buckets alike here and in SQL.
_PRIME, _FACTOR = 2_147_483_647, 48_271


def bucket_column(n: int):
    return ((F.pmod("_doc", F.lit(_PRIME)) * _FACTOR + F.pmod("_sub", F.lit(_PRIME))) % _PRIME % n).cast("int")


def _bucket(doc: np.ndarray, sub: np.ndarray, n: int) -> np.ndarray:
    return (np.mod(doc.astype(np.int64), _PRIME) * _FACTOR + np.mod(sub.astype(np.int64), _PRIME)) % _PRIME % n


def _key_part(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def reaches(units: Units) -> list[tuple[int, int, int]]:
    """The classes of windows: the least and most units before the gram, and the units that all windows of the class have behind it."""
    room = units.window - units.gram
    least = [room * i // CLASSES for i in range(CLASSES)] + [room + 1]
    return [(a, b - 1, room + 1 - b) for a, b in zip(least, least[1:], strict=False)]


def _spans(doc, sub, start, end, n_buckets: int) -> list[tuple[int, int, bytes]]:
    """Spans go to their documents' bucket, written as a negative part."""
    return dealt(-1 - _bucket(doc, sub, n_buckets), SPANS, [doc, sub, start, end], SPAN)


def runs_of(units: Units, texts: Texts) -> tuple[np.ndarray, list[np.ndarray]]:
    """Runs of windows that share an anchor: the gram's hash; row, both halves of the id, first window, number of windows, the gram's place in the first, a name for each class (0: no windows)."""
    begins, first, words = units.split(texts)
    lengths = np.diff(first)
    at = ranges(first[:-1], np.maximum(lengths - units.window + 1, 0))
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), [empty, *(empty.astype(np.uint64),) * 2, *(empty,) * (3 + CLASSES)]
    grams = ranges(first[:-1], np.maximum(lengths - units.gram + 1, 0))
    keys = np.full(int(first[-1]), np.iinfo(np.uint64).max, np.uint64)
    keys[grams] = units.grams(texts, words)[grams]
    anchor = sliding_argmin(keys, units.window - units.gram + 1)[at]
    begin = np.flatnonzero(np.diff(anchor, prepend=-1))
    start, run, anchor = at[begin], np.diff(np.append(begin, len(at))), anchor[begin]
    ids = digests(units.content(texts, words), begins[start], begins[start + run - 1 + units.window])
    row, ahead, names = np.searchsorted(first, start, "right") - 1, anchor - start, []
    for i, (least, most, behind) in enumerate(reaches(units)):
        has = np.flatnonzero((ahead >= least) & (ahead - run < most))
        name = np.zeros(len(start), np.uint32)
        ends = paired(paired(keys[anchor[has] - least], keys[anchor[has] + behind]), keys[anchor[has]] + np.uint64(i))
        name[has] = (ends >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        names.append(name)
    return keys[anchor], [row, *ids, start - first[row], run, ahead, *names]


def _map_runs(units: Units, n_groups: int, n_buckets: int):
    def told(some: list[tuple[np.ndarray, ...]]) -> pa.Table:
        part, one, two, doc, sub, start, n, *rest = (np.concatenate(x) for x in zip(*some, strict=True))
        order, stay = _earliest((one, two), doc, sub, start, units.within)
        gone, stay = order[~stay], np.sort(order[stay])
        out = dealt(part[stay], RUNS, [x[stay] for x in (one, two, doc, sub, start, n, *rest)], RUN)
        return batch(out + _spans(doc[gone], sub[gone], start[gone], start[gone] + n[gone] - 1 + units.window, n_buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # enough runs for all groups are dealt at once, so that the rows sent don't grow with the number of groups
        some, n_runs = [], 0
        for rows, texts in chunks(batches):
            key, (row, one, two, *rest) = runs_of(units, texts)
            doc, sub = (rows.column(c).to_numpy(zero_copy_only=False)[row] for c in (0, 1))
            some.append((_key_part(key, n_groups), one, two, doc, sub, *(x.astype(k) for x, k in zip(rest, RUN[4:], strict=True))))
            n_runs += len(row)
            if n_runs >= min(RUNS_EACH * n_groups, RUNS_MOST):
                yield from told(some).to_batches()
                some, n_runs = [], 0
        if some:
            yield from told(some).to_batches()

    return run


def _shared(name: np.ndarray, different: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose name (not 0) places of another number in `different` have as well, and how many different ones have it."""
    in_order = np.sort(name)
    again = in_order[1:][(in_order[1:] == in_order[:-1]) & (in_order[1:] > 0)]
    again = again[np.diff(again, prepend=0) != 0] if len(again) else again
    if not len(again):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.minimum(np.searchsorted(again, name), len(again) - 1)
    own = np.flatnonzero(again[of] == name)
    own = own[np.lexsort((different[own], of[own]))]
    of, d = of[own], different[own]
    new = np.ones(len(own), bool)
    new[1:] = (of[1:] != of[:-1]) | (d[1:] != d[:-1])
    n = np.bincount(of, new, minlength=len(again)).astype(np.int64)[of]
    return own[n > 1], n[n > 1]


def _meet_runs(units: Units, n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        if part < 0:
            return table
        (one, two, doc, sub, start, n, ahead, *names), _ = unpacked(table["data"].to_pylist(), RUN)
        order, stay = _earliest((one, two), doc, sub, start, units.within)
        gone, stay = order[~stay], order[stay]
        out = _spans(doc[gone], sub[gone], start[gone], start[gone] + n[gone] - 1 + units.window, n_buckets)
        # those that stay are in order of ids
        i, j = one[stay], two[stay]
        different = np.cumsum((np.diff(i, prepend=~i[:1]) != 0) | (np.diff(j, prepend=~j[:1]) != 0))
        doc, sub, start, n, ahead = doc[stay], sub[stay], start[stay], n[stay].astype(np.int64), ahead[stay].astype(np.int64)
        # windows of neighbouring classes that are asked go together, those of hot names by themselves; none goes twice
        few, hot = np.zeros((2, len(stay), CLASSES + 2), bool)
        for c, name in enumerate(names, 1):
            asked, count = _shared(name[stay], different)
            few[asked, c], hot[asked, c] = count <= HOT_RUNS, count > HOT_RUNS
        own, low = np.nonzero(few[:, 1:-1] & ~few[:, :-2])
        high = np.nonzero(few[:, 1:-1] & ~few[:, 2:])[1]
        alone, c = np.nonzero(hot[:, 1:-1])
        hot = np.repeat([0, 1], [len(own), len(alone)])
        own, low, high = np.append(own, alone), np.append(low, c), np.append(high, c)
        bounds = np.array(reaches(units))
        begin = np.maximum(ahead[own] - bounds[high, 1], 0)
        end = np.minimum(ahead[own] - bounds[low, 0], n[own] - 1) + 1
        return batch(out + dealt(-1 - _bucket(doc[own], sub[own], n_buckets), WISHES, [np.full(len(own), part), doc[own], sub[own], start[own] + begin, end - begin, hot], WISH))

    return run


def _locate(docs: pa.Table, doc: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """The row of docs of each (doc, sub)."""
    d, s = docs["_doc"].to_numpy(), docs["_sub"].to_numpy()
    order = np.lexsort((s, d))
    if not len(order):
        return np.zeros(0, np.int64)
    d, s = d[order], s[order]
    if (d[1:] != d[:-1]).all():
        return order[np.searchsorted(d, doc)]
    have, asked = (np.rec.fromarrays(x, names="d,s") for x in ([d, s], [doc, sub]))
    return order[np.searchsorted(have, asked)]


def _segments(units: Units, n_groups: int, n_buckets: int):
    """The texts of the windows that were asked for; a hot name's windows one by one."""

    def run(docs: pa.Table, wishes: pa.Table) -> pa.Table:
        (part, doc, sub, start, n, hot), _ = unpacked([d for k, d in zip(wishes["kind"].to_pylist(), wishes["data"].to_pylist(), strict=True) if k == WISHES], WISH)
        if not len(part):
            return batch([])
        texts = texts_of(docs["text"])
        begins, first, words = units.split(texts)
        row = _locate(docs, doc, sub)
        # a hot name's windows are segments of one window each
        each = np.where(hot != 0, n, 1)
        own = np.repeat(np.arange(len(part)), each)
        start = start[own] + ranges(np.zeros(len(part), np.int64), each)
        n, alone, out = np.where(hot[own] != 0, 1, n[own]), hot[own] != 0, []
        begin = first[row[own]] + start
        end = begin + n - 1 + units.window
        part = part[own].astype(np.int64)
        if alone.any():
            ids = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)
            ids[0][alone], ids[1][alone] = digests(units.content(texts, words), begins[begin[alone]], begins[end[alone]])
            part[alone] = _key_part(ids[0][alone], n_groups)
            which = np.flatnonzero(alone)
            order, stay = _earliest((ids[0][which], ids[1][which]), doc[own][which], sub[own][which], start[which], units.within)
            gone = which[order[~stay]]
            out += _spans(doc[own][gone], sub[own][gone], start[gone], start[gone] + units.window, n_buckets)
            keep = np.ones(len(own), bool)
            keep[gone] = False
            own, start, n, begin, end, part = (x[keep] for x in (own, start, n, begin, end, part))
        lo, hi = (words.start[begin], words.end[end - 1]) if units.words else (begin, end)
        out += dealt(part, SEGMENTS, [doc[own], sub[own], start, n, hi - lo], SEGMENT, hi - lo, texts.data, lo)
        return batch(out)

    return run


def _search(units: Units, search: Search, n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() < 0:
            return table
        rows = list(zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True))
        out = []
        (doc, sub, start, n, size), data = unpacked([d for k, d in rows if k == SEGMENTS], SEGMENT)
        if len(doc):
            texts = Texts(np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(size, dtype=np.int64)]))
            _, first, words = units.split(texts)
            codes = texts.data if words is None else words.exact()
            of = np.repeat(np.arange(len(doc)), n)
            at = ranges(first[:-1], n)
            where = start[of] + at - first[of]
            rank = np.empty(len(of), np.int64)  # of a window in the order of (doc, sub, start)
            rank[np.lexsort((where, sub[of], doc[of]))] = np.arange(len(of))
            covered = search(units, codes, first, at, rank if units.within else np.unique(doc, return_inverse=True)[1][of], of)
            of, where = of[covered], where[covered]
            order = np.lexsort((where, sub[of], doc[of]))  # neighbours become one span
            of, where = of[order], where[order]
            edge = np.ones(len(of), bool)
            edge[1:] = (where[1:] > where[:-1] + 1) | (doc[of][1:] != doc[of][:-1]) | (sub[of][1:] != sub[of][:-1])
            begin = np.flatnonzero(edge)
            last = np.append(begin[1:], len(of)) - 1
            out += _spans(doc[of[begin]], sub[of[begin]], where[begin], where[last] + units.window, n_buckets) if len(of) else []
        return batch(out)

    return run


def _cut(units: Units, as_text: bool):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return docs.select(["_doc", "_sub"]).append_column("n_units", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64())).append_column("n_spans", pa.array([], pa.int64())).append_column("kept", pa.array([], pa.binary()))
        texts = texts_of(docs["text"])
        (doc, sub, start, end), _ = unpacked([d for k, d in zip(spans["kind"].to_pylist(), spans["data"].to_pylist(), strict=True) if k == SPANS], SPAN)
        words = Words(texts) if units.words else None
        first = words.first if units.words else texts.offsets
        row = _locate(docs, doc, sub)
        change = np.zeros(int(first[-1]) + 1, np.int64)
        np.add.at(change, first[row] + start, 1)
        np.add.at(change, first[row] + end, -1)
        gone = np.cumsum(change[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = first[(first > 0) & (first < len(gone))]
        begins[inner] = gone[inner]
        n_spans = np.concatenate([[0], np.cumsum(begins)])
        kept = []
        for r in range(len(texts)):
            lo, hi = int(first[r]), int(first[r + 1])
            if units.words:
                all_words = texts.row_bytes(r).split()
                kept.append(b" ".join(all_words if total[hi] == total[lo] else [w for w, x in zip(all_words, gone[lo:hi].tolist(), strict=True) if not x]))
            else:
                left = texts.data[lo:hi][~gone[lo:hi]].tobytes()
                kept.append(left.decode("utf-8", "ignore").encode() if as_text else left)
        columns = [np.diff(first), total[first[1:]] - total[first[:-1]], n_spans[first[1:]] - n_spans[first[:-1]]]
        return pa.table([docs["_doc"], docs["_sub"], *(pa.array(c.astype(np.int64)) for c in columns), pa.array(kept, pa.binary())], ["_doc", "_sub", "n_units", "n_removed", "n_spans", "kept"])

    return run


def without_covered(rows: DataFrame, units: Units, search: Search, as_text: bool = False) -> DataFrame:
    """_doc, _sub, n_units, n_removed, n_spans and kept (bytes; as_text: without characters cut in two) of every row (_doc, _sub, text)."""
    size = volume(rows)
    n_buckets = max(parts(rows), dealt_among(size, BUCKET_DOCS))
    n_groups = max(parts(rows), min(4 * parts(rows), GROUPS_EVEN), dealt_among(size, RUN_DOCS))

    met = checkpointed(rows.mapInArrow(_map_runs(units, n_groups, n_buckets), DEALT).groupBy("part").applyInArrow(_meet_runs(units, n_buckets), DEALT))

    by_bucket = rows.withColumn("bucket", bucket_column(n_buckets))
    segments = _together(by_bucket, met, WISHES).applyInArrow(_segments(units, n_groups, n_buckets), DEALT)
    found = segments.groupBy("part").applyInArrow(_search(units, search, n_buckets), DEALT)
    spans = met.filter(F.col("kind") == SPANS).unionByName(found)
    return _together(by_bucket, spans, SPANS).applyInArrow(_cut(units, as_text), "_doc long, _sub long, n_units long, n_removed long, n_spans long, kept binary")


def _together(by_bucket: DataFrame, dealt_rows: DataFrame, kind: int):
    """Documents and the rows of one kind that are meant for them, bucket by bucket."""
    own = dealt_rows.filter((F.col("kind") == kind) & (F.col("part") < 0)).withColumn("bucket", (-1 - F.col("part")).cast("int"))
    return by_bucket.groupBy("bucket").cogroup(own.groupBy("bucket"))
