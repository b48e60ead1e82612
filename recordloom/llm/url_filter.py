"""URL filters by a sort-merge range join.

A host's labels in reverse order, each closed by a dot, make a key under which a host and all its subdomains are one
interval. Pages and rules are cut into ranges of that key (a rule goes to every range its interval meets), sorted, and
swept once: a stack holds the rules whose intervals contain the current key, the innermost on top.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys drawn for each range from which the ranges' bounds are taken.
_DRAWN = 64
_FIELDS = "range int, key string, kind int, salt long, page_id long, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty where there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """example.net becomes net.example. — a rule without a host spans all keys."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """The verdict on each page's url: page_id, host, path, rule, verdict. rules: host, path, verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's. Of several the one with the
    longest text (host and path) wins, then the one with the longer host; of equal rules with different verdicts
    block wins. Without a rule the rule is null and the verdict is default. A null url, or one without ://, has an
    empty host and path. Null or repeated page ids are kept as rows of their own; rules with a null part count as
    having it empty. Empty tables give no rows; further columns are not looked at.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64("page_id", "url").alias("salt"))
    p = p.withColumn("key", host_key(F.col("host")))
    total = p.count()
    # Bounds from a bounded draw by hash. They hold the salt too, so a host with very many pages is cut into several ranges.
    every = max(1, total // (ranges * _DRAWN))
    drawn = sorted((r.key, r.salt) for r in p.where(F.pmod(F.col("salt"), F.lit(every)) == 0).select("key", "salt").limit(4 * ranges * _DRAWN).collect())
    bounds = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []

    def place_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(bounds, x) for x in zip(b.column("key").to_pylist(), b.column("salt").to_pylist(), strict=True)]
            none = pa.nulls(len(at), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column("key"), pa.array([1] * len(at), pa.int32()), *(b.column(c) for c in ("salt", "page_id", "host", "path")), none, none], names=_names)

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                key, end = r["key"], r["key"][:-1] + "/" if r["key"] else chr(0x10FFFF)
                first, last = bisect_right(bounds, (key, -(1 << 63))), bisect_right(bounds, (end, -(1 << 63)))
                rows += [(i, key, 0, 0, None, r["host"], r["path"], r["host"] + r["path"], r["verdict"]) for i in range(first, last + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _types, strict=True)], names=_names)

    r = rules.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path", "verdict"))).withColumn("host", F.translate("host", _UPPER, _LOWER))
    r = r.withColumn("key", host_key(F.col("host")))
    both = p.mapInArrow(place_pages, _FIELDS).unionAll(r.mapInArrow(place_rules, _FIELDS))
    swept = both.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "key", "kind")
    return swept.mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")


_names = [x.split()[0] for x in _FIELDS.split(", ")]
_types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in _FIELDS.split(", ")]


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list[tuple[int, int, str, str, str]]]] = []  # key, rules of one host
        here = None
        for b in batches:
            rule_out, verdict_out, keep = [], [], []
            cols = (b.column(c).to_pylist() for c in ("range", "key", "kind", "host", "path", "rule", "verdict"))
            for i, (at, key, kind, host, path, rule, verdict) in enumerate(zip(*cols, strict=True)):
                if at != here:
                    stack, here = [], at
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((len(rule), len(host), verdict == "block", path, rule, verdict))
                    continue
                best = max((x for _, own in stack for x in own if path.startswith(x[3])), default=None)
                keep.append(i)
                rule_out.append(best[4] if best else None)
                verdict_out.append(best[5] if best else default)
            if keep:
                b = b.take(pa.array(keep, pa.int64())) if len(keep) < b.num_rows else b
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path")), pa.array(rule_out, pa.string()), pa.array(verdict_out, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return run
