"""Byte-pair encoding and decoding by dynamic programming over prefixes.

Of the tokens that end where a prefix of a word ends, exactly one is the last token of that prefix's encoding: the one
that is compatible with the last token of what stands before it. An automaton over the vocabulary gives the tokens
that are suffixes of each prefix; back-pointers from the whole word then give its ids. Two tokens are compatible if
undoing their merges, the latest first, never shows a pair across their border that would have been merged earlier.
"""

from __future__ import annotations

import json
import sys
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, list_array, map_steps

#: Words that a worker remembers, the longest of them, and remembered pairs.
WORDS, LONGEST, PAIRS = 200_000, 48, 200_000


def byte_letters() -> list[str]:
    """The letter for each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(0x100 + hidden.index(b)) for b in range(256)]


class Tokenizer:
    """A byte-level BPE tokenizer read from a tokenizers JSON file; what is remembered of words and pairs is bounded."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.letters = str.maketrans(dict(enumerate(letters)))
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(self.byte_of[c] for c in t) for t, i in vocab.items() if all(c in self.byte_of for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.pattern = regex.compile(pattern)
        self.split_special = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.made: dict[tuple[int, int], int] = {}  # pair: rank of its merge
        self.rank, self.parts = {}, {}  # token: rank of the merge that makes it, and what it merges
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.made.setdefault((left, right), rank)
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = rank, (left, right)
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if len(t) == 1 or i in self.rank:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two stay apart when what they spell is encoded."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        # Undone last: the rank and the side of the merge that consumed one of the two tokens at the border.
        # Merges happen by rank, of one rank from left to right.
        soonest = (1 << 60, 0)
        while True:
            rank = self.made.get((left, right))
            if rank is not None and (rank, 1) < soonest:
                return False
            of_left, of_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            # Of equal ranks the left one happened first, so the right one is undone first.
            if of_left > of_right:
                soonest, left = (of_left, 0), self.parts[left][1]
            else:
                soonest, right = (of_right, 2), self.parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in the vocabulary's letters."""
        n = len(word)
        last, size = [-1] * (n + 1), [0] * (n + 1)  # per prefix: its last token, and that token's length
        known = self.pairs.get
        for end, (token, k) in self.automaton.iter(word):
            end += 1
            if size[end]:
                continue
            before = end - k
            if before:
                if not size[before]:
                    continue
                left = last[before]
                apart = known((left, token))
                if not (self.compatible(left, token) if apart is None else apart):
                    continue
            last[end], size[end] = token, k
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        ids.reverse()
        return ids

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text, special tokens where their texts stand."""
        out = []
        for piece in self.split_special.split(text) if self.split_special else [text]:
            if piece in self.special:
                out.append(np.array([self.special[piece]], np.uint32).tobytes())
            elif piece:
                out += map(self.words.__getitem__, self.pattern.findall(piece))
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


class _Words(dict):
    """Ids, as little-endian bytes, of words met before."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        t = self.tokenizer
        ids = array("I", t.encode_word(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(t.letters)))
        if sys.byteorder == "big":
            ids.byteswap()
        ids = ids.tobytes()
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """Read once for a stage in each Python process."""
    return held(("bpe", path, pattern), lambda: Tokenizer(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, ids (array<int>), n_tokens. path: a tokenizers JSON file that every machine has.

    A null text is encoded as the empty one, to no ids. Null or repeated document ids are kept as rows of their own.
    An empty table gives no rows; further columns are not looked at.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(path, pattern)
        ids = [t.encode(x or "") for x in batch.column("text").to_pylist()]
        sizes = np.array([len(x) for x in ids], np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(np.concatenate(ids).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(sizes)], names=["doc_id", "ids", "n_tokens"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_steps(d, kernel, "doc_id long, ids array<int>, n_tokens long", key=("bpe", path, pattern))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encode()'s rows with decoded, the text of their ids. Null ids decode to the empty text."""

    def run(batches):
        t = tokenizer(path, pattern)
        for b in batches:
            ids = b.column("ids")
            texts = [t.decode(np.asarray(x.values, np.int64)) if x.is_valid else "" for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, b.column("n_tokens"), pa.array(texts, pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass, by one Python worker for each task: doc_id, n_tokens, ids, decoded.

    ids are little-endian unsigned 32-bit integers, one after another. Null and empty texts have no ids and decode to
    the empty text; null or repeated ids of documents, empty tables and further columns are as in encode().
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(path, pattern)
        ids = [t.encode(x or "") for x in batch.column("text").to_pylist()]
        packed, texts = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([t.decode(x) for x in ids], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), packed, texts], names=["doc_id", "n_tokens", "ids", "decoded"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_steps(d, kernel, "doc_id long, n_tokens long, ids binary, decoded string", key=("bpe", path, pattern))


def digest(done: DataFrame) -> DataFrame:
    """round_trip()'s rows with hashes of the ids and of the text, taken by the JVM."""
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
