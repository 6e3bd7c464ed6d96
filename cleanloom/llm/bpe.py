"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A batch is cut into words by classes of its characters, in numpy: the words are just the matches of
the pattern that public byte-level vocabularies are split by. Arrow's exact dictionary then leaves each
distinct word once; the tokenizers library encodes those that the worker hasn't met, as one piece each,
with its byte-to-character mapping; ids and offsets are dealt back to all occurrences by index arithmetic.
So the merges run once per distinct word, not once per occurrence.

Decoding reverses the byte table: characters of the vocabulary's strings to bytes, bytes joined, and a
character that is split over several ids comes out whole, because bytes are joined before UTF-8 is read.

Defined results: null counts as an empty text and gives no ids; strings of special tokens within a text
are ordinary text; repeated rows give repeated results; texts of any length are taken whole, long ones walked in parts that
start at blanks between ASCII letters or digits (without such blanks: about 60 bytes of memory for each byte); pairs of equal rank merge from the left; an empty table gives an empty result; other columns of the input
aren't looked at.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _shared as sh

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct words that a worker remembers before it forgets the half that it has not met for the longest time.
CACHE_WORDS = 600_000
#: Bytes of text that are cut into words at a time.
SLICE_BYTES = 2 << 20

LETTER, NUMBER, SPACE, OTHER = range(4)


@functools.cache
def character_classes() -> np.ndarray:
    """The class of each code point, by the Unicode tables of the tiktoken library, whose matches count."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        # With single bytes as its tokens, what this encodes is just the characters that match.
        matched = tiktoken.Encoding("one", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(every)
        found[np.frombuffer(bytes(matched).decode().encode("utf-32-le"), np.uint32)] = kind
    return found


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it is printable, the next free one from 256 on otherwise."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """True where a word starts. points: the code points of all texts, one after the other; doc_starts: where (non-empty) texts start."""
    n = len(points)
    kind = character_classes()[points]
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start[doc_starts] = True
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    of_text = np.zeros(n + 1, bool)
    of_text[doc_starts] = True
    of_text[n] = True
    # Spaces before something else: the last one stays out of the run, and a blank goes to what follows.
    blank_runs = (kind[runs] == SPACE) & ~of_text[ends]
    last = ends[blank_runs] - 1
    start[last] = True
    joined = last[points[last] == 0x20]
    start[joined + 1] = False
    # Contractions: a lone apostrophe that opens a word, before letters.
    at = runs[(points[runs] == 0x27) & (ends - runs == 1) & (kind[runs] == OTHER)]
    at = at[start[at] & ~of_text[at + 1]]
    if len(at):
        padded = np.append(points, [0, 0])
        first, second = padded[at + 1], np.where(of_text[np.minimum(at + 2, n)], 0, padded[at + 2])
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = np.zeros(len(at), bool)
        for pair in ("re", "ve", "ll"):
            two |= (first == ord(pair[0])) & (second == ord(pair[1]))
        for hit, length in ((one, 2), (two & ~one, 3)):
            start[at[hit] + 1] = False
            after = at[hit] + length
            start[after[after < n]] = True
    return start


_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True


class Encoder:
    """Encodes Arrow arrays of texts. tokenizer: of the tokenizers library; it gets single words."""

    def __init__(self, tokenizer, offsets: bool = False) -> None:
        from tokenizers import pre_tokenizers

        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        tokenizer.encode_special_tokens = True
        self.tokenizer, self.offsets, self.known = tokenizer, offsets, {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.flat = np.empty(0, np.uint32)
        self.flat_from = np.empty(0, np.int32)
        self.flat_to = np.empty(0, np.int32)
        self.at = np.empty(0, np.int64)
        self.many = np.empty(0, np.int64)
        self.met = np.empty(0, np.int32)
        self.now = 0

    def forget_half(self) -> None:
        """Keeps the words met last."""
        kept = np.sort(np.argsort(-self.met, kind="stable")[: len(self.met) // 2])
        names, places = list(self.known), sh.ragged(self.at[kept], self.many[kept])
        self.known = dict(zip([names[k] for k in kept.tolist()], range(len(kept)), strict=True))
        self.flat = self.flat[places]
        if self.offsets:
            self.flat_from, self.flat_to = self.flat_from[places], self.flat_to[places]
        self.many, self.met = self.many[kept], self.met[kept]
        self.at = np.cumsum(self.many) - self.many

    def find(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))

    def learn(self, words: list[str]) -> None:
        got = (self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast)(words, add_special_tokens=False)
        ids = [e.ids for e in got]
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(many) - many])
        self.many = np.concatenate([self.many, many])
        self.met = np.append(self.met, np.zeros(len(many), np.int32))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(many.sum()))])
        if self.offsets:
            places = np.array([o for e in got for o in e.offsets], np.int32).reshape(-1, 2)
            self.flat_from = np.concatenate([self.flat_from, places[:, 0]])
            self.flat_to = np.concatenate([self.flat_to, places[:, 1]])
        self.known.update(zip(words, range(len(self.known), len(self.many)), strict=True))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """All ids, how many each text has, and with offsets the characters of its text from which to which each id reaches."""
        data, at = sh.text_buffer(texts)
        if len(at) != 2 or len(data) <= sh.LONG_BYTES:
            return self._encoded(data, at)
        # A part starts at a blank between ASCII letters or digits, where every split of the text has a word start.
        ends = sh.cuts(data, lambda x: 1 + np.flatnonzero(_PLAIN[x[:-2]] & (x[1:-1] == 0x20) & _PLAIN[x[2:]]))
        found = [self._encoded(data[a:b], np.array([0, b - a])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        ids, counts = np.concatenate([f[0] for f in found]), np.array([sum(len(f[0]) for f in found)])
        if not self.offsets:
            return ids, counts
        before = np.cumsum([0, *(int(((data[a:b] & 0xC0) != 0x80).sum()) for a, b in zip(ends[:-1], ends[1:], strict=True))])
        return ids, counts, *(np.concatenate([f[i] + n for f, n in zip(found, before[:-1], strict=True)]) for i in (2, 3))

    def _encoded(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        n_docs = len(at) - 1
        if not len(data):
            empty = np.empty(0, np.uint32), np.zeros(n_docs, np.int64)
            return (*empty, np.empty(0, np.int64), np.empty(0, np.int64)) if self.offsets else empty
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        full = at[:-1][at[1:] > at[:-1]]
        starts = np.flatnonzero(word_starts(points, np.searchsorted(leads, full)))
        byte_at = np.append(leads[starts], len(data)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(byte_at), pa.py_buffer(raw)).dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = self.find(names)
        missing = np.flatnonzero(which < 0)
        if len(missing) and len(self.known) + len(missing) > CACHE_WORDS:
            self.forget_half()
            which = self.find(names)
            missing = np.flatnonzero(which < 0)
        if len(missing):
            which[missing] = len(self.known) + np.arange(len(missing))
            self.learn([names[k] for k in missing.tolist()])
        self.now += 1
        self.met[which] = self.now
        which = which[words.indices.to_numpy()]
        many = self.many[which]
        places = sh.ragged(self.at[which], many)
        before = np.append(0, np.cumsum(many))[np.searchsorted(byte_at, at)]
        counts = np.diff(before)
        if not self.offsets:
            return self.flat[places], counts
        doc_of = np.searchsorted(at, byte_at[:-1], "right") - 1
        base = np.repeat(starts - np.searchsorted(leads, at[:-1])[doc_of], many)
        return self.flat[places], counts, base + self.flat_from[places], base + self.flat_to[places]


@functools.cache
def from_json(path: str) -> Encoder:
    """The encoder of a tokenizer file of the tokenizers library."""
    from tokenizers import Tokenizer

    sh.held("bpe", forget_all)
    return Encoder(Tokenizer.from_file(path))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens that joins to a token, by the joined token's rank, the pair with the shorter left side first."""
    pairs = []
    for token, rank in ranks.items():
        pairs += [(rank, k, token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
    return [(a, b) for _, _, a, b in sorted(pairs)]


@functools.cache
def from_ranks(path: str, offsets: bool = False) -> Encoder:
    """The encoder of a file of ranks: a word that is a token is that token; else the pair of the lowest rank merges first."""
    from tokenizers import Tokenizer, models

    ranks, shown = read_ranks(path), byte_characters()
    name = lambda token: "".join(map(shown.__getitem__, token))
    model = models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=[(name(a), name(b)) for a, b in merges_of(ranks)], ignore_merges=True)
    sh.held("bpe", forget_all)
    return Encoder(Tokenizer(model), offsets)


def forget_all() -> None:
    """Drops the encoders of this process, with the words that they know."""
    from_json.cache_clear()
    from_ranks.cache_clear()


class Decoder:
    """Turns ids into bytes by the reversed byte table."""

    def __init__(self, names: dict[int, str]) -> None:
        back = {c: b for b, c in byte_characters().items()}
        tokens = [b""] * (max(names) + 1 if names else 0)
        for i, name in names.items():
            tokens[i] = bytes(map(back.__getitem__, name)) if all(c in back for c in name) else name.encode()
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        return self.flat[sh.ragged(self.at[ids], self.lengths[ids])].tobytes()

    def many(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of several texts' ids, and how many bytes each text has."""
        size = self.lengths[ids]
        ends = np.append(0, np.cumsum(size))[np.cumsum(counts)]
        return self.flat[sh.ragged(self.at[ids], size)], np.diff(ends, prepend=0)


@functools.cache
def decoder_of_ranks(path: str) -> Decoder:
    shown = byte_characters()
    return Decoder({r: "".join(map(shown.__getitem__, t)) for t, r in read_ranks(path).items()})


def stream_text(decoder: Decoder, parts: Iterable[np.ndarray]) -> Iterator[str]:
    """Decodes ids that come in parts; a character whose bytes are split over two parts comes out with the later one."""
    text = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in parts:
        yield text.decode(decoder(ids))
    yield text.decode(b"", True)


def encode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """One row per row: the id, ids array<int>, and with `offsets` starts and ends array<int>, in characters of the text."""
    from pyspark.sql import types as T

    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("ids", ints), *[T.StructField(n, ints) for n in ("starts", "ends") if offsets]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = from_ranks(ranks_path, offsets)
        for batch in batches:
            for part in sh.slices(batch, 1, SLICE_BYTES):
                found = encoder(part.column(1))
                ends = pa.array(np.append(0, np.cumsum(found[1])).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (found[0], *found[2:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(sh.frugal(run, "bpe"), schema)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: the id, and data binary, the decoded bytes (null ids: empty)."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_of_ranks(ranks_path)
        for batch in batches:
            data = [decoder(np.asarray(x.values if x.is_valid else [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=schema.names)

    return df.select(id_col, ids_col).mapInArrow(sh.frugal(run, "bpe"), schema)


def round_trip_digests(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids again: doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (of the decoded bytes), all in one pass and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = from_ranks(ranks_path), decoder_of_ranks(ranks_path)
        for batch in batches:
            for part in sh.slices(batch, 1, SLICE_BYTES):
                ids, counts = encoder(part.column(1))
                data, sizes = decoder.many(ids, counts)
                ends, byte_ends = np.cumsum(counts), np.cumsum(sizes)
                raw, raw_data = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
                first = [hashlib.sha256(raw[4 * (e - n) : 4 * e]).hexdigest() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                second = [hashlib.sha256(raw_data[e - n : e]).hexdigest() for e, n in zip(byte_ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(sh.frugal(run, "bpe"), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def vocabulary_names(path: str) -> dict[int, str]:
    """Ids and strings of a tokenizer file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        return {i: name for name, i in json.load(f)["model"]["vocab"].items()}
