"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash over its last bytes has given low bits, so texts
that share a passage share the chunks inside it.  A chunk is encoded once and then
taken from a cache by its digest.  What stands between the last white space of one
chunk and the first of the next (over chunks without any, if need be) belongs to a
join: it is encoded anew as one string.  Beyond white space on both sides nothing
changes any more, so the joined ids agree with those of the whole text.

A worker process keeps its cache between tasks; the cache is bounded, and what it
has lost is only encoded again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from tallyloom.llm.textcols import Texts, chunks, rolling_hashes

#: How the vocabulary's pre-tokenizer cuts normalised text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words with other characters may be normalised in ways that the library alone knows.
UNVETTED = regex.compile("[^\t\n\r -~¡-ÿ]|<\\|")
#: The rolling hash sees so many bytes and cuts at one place in CHUNK on average.
ROLL, CHUNK = 24, 2048
#: Bounds of a process's caches, in entries.
KEPT_CHUNKS, KEPT_WORDS = 20_000, 600_000
_WHITE = b" \t\n\r"
#: Marks that often end a word.
_ENDINGS = b",.;:!?)|"
#: Starts the special tokens' strings, which stand for themselves before a text is normalised.
_SPECIAL = b"<|"


def _visible_bytes() -> dict[int, str]:
    """The vocabulary's characters for bytes: printable ones of Latin-1 for themselves, the others from 256 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class WordIds(dict):
    """Ids of what stands between white space, as little-endian unsigned 32-bit numbers, encoded at first use.

    In two generations of half the bound: when the younger one is full, it becomes the
    older one, whose words come back when they are used again.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.tokens_of = tokenizer, tokenizer.model.tokenize
        self.old: dict[bytes, bytes] = {}
        self.table = _visible_bytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.of(word)
        if len(self) >= KEPT_WORDS // 2:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def of(self, word: bytes) -> bytes:
        stem = word.rstrip(_ENDINGS)
        text = stem.decode("utf-8", "replace")
        if text.isalpha() and (stem.isalpha() or not UNVETTED.search(text)):  # one piece of letters; marks behind it are one more
            if len(stem) < len(word):
                return self[stem] + self[word[len(stem) :]]
            pieces = [text.lower()]
        else:
            text = word.decode("utf-8", "replace")
            if UNVETTED.search(text):
                return self.whole(text)
            pieces = PIECES.findall(text.lower())
        ids = [t.id for piece in pieces for t in self.tokens_of(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table))]
        return array("I", ids).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Encodes and decodes texts as the library does for the vocabulary file at `path`."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.words = WordIds(tokenizer)
        size = max(tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        self.tokens = [(tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.decimals = [b"%d" % i for i in range(size)]
        self.young: dict[bytes, tuple[bytes, bytes, bytes] | None] = {}
        self.old: dict[bytes, tuple[bytes, bytes, bytes] | None] = {}

    def encode_plain(self, raw: bytes) -> bytes:
        """Ids of a text without chunks."""
        if _SPECIAL in raw:
            return self.words.whole(raw.decode("utf-8", "replace"))
        return b"".join(map(self.words.__getitem__, raw.lower().split()))

    def _chunk(self, raw: bytes) -> tuple[bytes, bytes, bytes] | None:
        """What precedes the first white space, the ids up to the last one, what follows it; None without white space."""
        key = blake2b(raw, digest_size=16).digest()
        if key in self.young:
            return self.young[key]
        if key in self.old:
            got = self.old[key]
        else:
            places = [p for p in map(raw.find, (_WHITE[i : i + 1] for i in range(4))) if p >= 0]
            if places:
                first, last = min(places), max(raw.rfind(_WHITE[i : i + 1]) for i in range(4))
                got = (raw[:first], self.encode_plain(raw[first:last]), raw[last + 1 :])
            else:
                got = None
        if len(self.young) >= KEPT_CHUNKS // 2:
            self.old, self.young = self.young, {}
        self.young[key] = got
        return got

    def encode_all(self, texts: Texts) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        at, hashes = rolling_hashes(texts, ROLL)
        cuts = at[hashes % np.uint32(CHUNK) == 0] + ROLL
        if len(cuts):
            for _ in range(3):  # not inside a character
                inside = np.append(texts.data, 0)[cuts] >> 6 == 2
                cuts = cuts + inside
        firsts = np.searchsorted(cuts, texts.offsets, "right")
        data = texts.data.tobytes()
        for r in range(len(texts)):
            begin, end = int(texts.offsets[r]), int(texts.offsets[r + 1])
            edges = [begin, *(c for c in cuts[firsts[r] : firsts[r + 1]].tolist() if begin < c < end), end]
            out, open_end = [], b""
            for lo, hi in zip(edges, edges[1:], strict=False):
                raw = data[lo:hi]
                got = self._chunk(raw)
                if got is None:
                    open_end += raw
                else:
                    out += [self.encode_plain(open_end + got[0]), got[1]]
                    open_end = got[2]
            out.append(self.encode_plain(open_end))
            yield b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return np.frombuffer(next(self.encode_all(Texts(raw, np.array([0, len(raw)])))), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode()

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The vocabulary has no decoder: its tokens, special ones too, joined by spaces."""
        return b" ".join(map(self.tokens.__getitem__, ids))

    def decimal(self, ids: list[int]) -> bytes:
        return b" ".join(map(self.decimals.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the ids of each text."""
    one = encoder(path)
    for rows, texts in chunks(batches):
        yield rows, list(one.encode_all(texts))


def vocabulary(path: str | None = None) -> str:
    """The vocabulary file to use: the given one, else the word BPE of the public tokenizers package."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_round_trip(docs, path: str | None = None):
    """Ids and decoded text of every text: doc_id, n_tokens, ids (array of int), decoded.

    A null text is empty and has no tokens; other columns are ignored; equal rows
    each give their row.
    """
    where = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(where)
        for rows, all_ids in encoded(batches, where):
            ids = [np.frombuffer(x, "<u4") for x in all_ids]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([one.decode_bytes(x.tolist()).decode() for x in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def bpe_digests(docs, path: str | None = None):
    """The digests of bpe_round_trip's columns, made where the ids are: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    where = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        one = encoder(where)
        for rows, all_ids in encoded(batches, where):
            out = []
            for raw in all_ids:
                ids = np.frombuffer(raw, "<u4").tolist()
                out.append((len(ids), sha256(one.decimal(ids)).hexdigest(), sha256(one.decode_bytes(ids)).hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
