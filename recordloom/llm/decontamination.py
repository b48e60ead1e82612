"""Benchmark decontamination with an Aho-Corasick automaton over words.

The test items, normalised to words, are cut into blocks of half a window; these are the patterns of one automaton,
whose letters are numbers of words. Every window of an item holds a whole block, so a document, normalised the same way
and scanned once, shows in its matches all places where a window may stand. From a match the document and the item are
followed word by word both ways; where they agree for a window or more, these words are hit, and their places give
offsets in the original text. The automaton has a node for each word of the benchmark at most.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, held, lower, map_steps, materialize

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of a window, and about as many bytes of benchmark text in one automaton (some 20 bytes of memory for each).
WINDOW, CHUNK_BYTES = 10, 8 << 20
#: Words of an item and a document that are compared at once.
_STEP = 64


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower(text)) if text else []


class Automaton:
    """Blocks of the items' words, and where each block stands."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.window, self.block = window, (window + 1) // 2
        self.number: dict[str, int] = {}  # of words, from 1; words that no item has are 0
        self.ids = [str(i) for i, _ in items]
        words, starts, places = [], [0], {}
        for k, (_, text) in enumerate(items):
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words_of(text)]
            words += w
            # An item shorter than a window is one window and one block.
            step = self.block if len(w) >= window else max(1, len(w))
            for at in range(0, len(w) - step + 1, step):
                places.setdefault(tuple(w[at : at + step]), []).append((k, starts[-1] + at))
            starts.append(len(words))
        self.words, self.starts = np.array(words, np.int32), starts
        self.places, self.sizes = list(places.values()), [len(x) for x in places]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, pattern in enumerate(places):
            self.automaton.add_word(pattern, i)
        if places:
            self.automaton.make_automaton()

    def hits(self, words: list[str]) -> tuple[list[list[int]], set[str]]:
        """Merged spans of hit words, as places, and the ids of items that have windows there."""
        if not self.places or not words:
            return [], set()
        doc = tuple(map(self.number.get, words, repeat(0)))
        spans, ids, seen, line = [], set(), {}, None
        for last, i in self.automaton.iter(doc):
            n = self.sizes[i]
            first = last + 1 - n
            if line is None:
                line = np.array(doc, np.int32)
            for k, at in self.places[i]:
                if seen.get((k, first - at), -1) >= last:  # inside a run that is known already
                    continue
                a = first - self._same(line[:first][::-1], self.words[self.starts[k] : at][::-1])
                b = last + 1 + self._same(line[last + 1 :], self.words[at + n : self.starts[k + 1]])
                seen[k, first - at] = b - 1
                if b - a >= min(self.window, self.starts[k + 1] - self.starts[k]):
                    spans.append((a, b))
                    ids.add(self.ids[k])
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return merged, ids

    @staticmethod
    def _same(a: np.ndarray, b: np.ndarray) -> int:
        """How many words agree from the start."""
        n, most = 0, min(len(a), len(b))
        while n < most:
            differ = np.flatnonzero(a[n : min(n + _STEP, most)] != b[n : min(n + _STEP, most)])
            if len(differ):
                return n + int(differ[0])
            n += _STEP
        return most


def chunks_of(benchmark: DataFrame, item_col: str, text_col: str) -> list[list[tuple[object, str | None]]]:
    """The items, dealt by hash into as many chunks as their bytes need; each is brought to the driver and to the workers by itself."""
    b = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    n = max(1, -(-int(b.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // CHUNK_BYTES))
    return [[(r.i, r.t) for r in b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()] for k in range(n)]


def _kernel(docs: DataFrame, items, window: int):
    """A function from a batch to the words and hits of its texts. The automaton is built once in a worker and kept while it serves this."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    key = ("decontamination", uuid.uuid4().hex)

    def found(texts: list[str | None]):
        automaton = held(key, lambda: Automaton(shared.value, window))
        for t in texts:
            words = words_of(t)
            yield t, words, *automaton.hits(words)

    return key, found


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_SPAN = "spans array<struct<a:long,b:long,start:long,end:long>>"


def _pass(d: DataFrame, items, window: int) -> DataFrame:
    """row, doc_id, n_words, items, spans of every document, for one chunk of the benchmark."""
    key, found = _kernel(d, items, window)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, ids, spans = [], [], []
        for text, words, merged, of in found(batch.column("text").to_pylist()):
            places = [m.span() for m in WORD.finditer(lower(text))] if merged else []
            counts.append(len(words))
            ids.append(sorted(of))
            spans.append([{"a": a, "b": b, "start": places[a][0], "end": places[b - 1][1]} for a, b in merged])
        columns = [batch.column("row"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, _SPANS)]
        return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_words", "items", "spans"])

    return map_steps(d, kernel, f"row long, doc_id long, n_words long, items array<string>, {_SPAN}", key=key)


def _merged(batches):
    """Rows with several passes' hits, merged."""
    for b in batches:
        out = []
        for lists in b.column("lists").to_pylist():
            spans: list[dict] = []
            for x in sorted((x for some in lists for x in some), key=lambda x: (x["a"], x["b"])):
                if spans and x["a"] <= spans[-1]["b"]:
                    if x["b"] > spans[-1]["b"]:
                        spans[-1] |= {"b": x["b"], "end": x["end"]}
                else:
                    spans.append(dict(x))
            out.append(spans)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_words", "items")), pa.array(out, _SPANS)], names=["doc_id", "n_words", "items", "spans"])
    give_back()


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids as text), spans (merged start and end offsets of hits, in code points), contaminated.

    A window is so many consecutive words of an item; an item of fewer words, but not none, is one window. A word of a
    document inside any occurrence of a window is hit. Null texts have no words; items without words match nothing;
    items repeated under one id count once; a null item id is listed as None. Null or repeated document ids are kept
    as rows of their own. An empty benchmark leaves every document clean. Further columns are not looked at. A benchmark
    of more than CHUNK_BYTES is scanned for in several passes, each with an automaton, whose hits are then merged.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = chunks_of(benchmark, item_col, text_col)
    if len(chunks) == 1:
        out = _pass(d.withColumn("row", F.lit(0).cast("long")), chunks[0], window)
    else:
        d = materialize(d.withColumn("row", F.monotonically_increasing_id()), "scan-rows")
        passes = [materialize(_pass(d, c, window), "scan-pass") for c in chunks]
        every = passes[0]
        for p in passes[1:]:
            every = every.unionAll(p.where(F.size("spans") > 0))
        every = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.collect_list("spans").alias("lists"))
        out = materialize(every.mapInArrow(_merged, f"doc_id long, n_words long, items array<string>, {_SPAN}"), "scan-merged")
        discard(d, *passes)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    spans = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), "items", spans.alias("spans"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", bench_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that hold no window of the benchmark. Rows as in scan(); nothing is shuffled."""
    for c in chunks_of(benchmark, item_col, bench_col):
        key, found = _kernel(docs, c, window)

        def kernel(batch: pa.RecordBatch, found=found) -> pa.RecordBatch:
            at = batch.schema.get_field_index(text_col)
            return batch.filter(pa.array([not merged for _, _, merged, _ in found(batch.column(at).to_pylist())], pa.bool_()))

        docs = map_steps(docs, kernel, docs.schema, text=text_col, key=key)
    return docs


def digest(scanned: DataFrame) -> DataFrame:
    """The scan with its items as a count and a hash."""
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def brute_force(text: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """One document by the definition, for tests."""
    words, hit, ids = words_of(text), set(), set()
    for item, body in items:
        w = words_of(body)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)
