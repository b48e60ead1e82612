"""Registered queries of the codec: what goes in must come out, so the SQL of each is a plain SELECT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import packing, profiles
from ..session import scratch_path, spread
from ..sources import json as json_source
from ..sources import packed as packed_source
from ..streaming import frames
from .catalog import query, table

#: Tables and the order in which their records are packed.
TABLES = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey"], "events": ["user_id", "ts", "event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"],
    "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}


def _pack_query(name: str, order: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, name)
        return packing.unpack(packing.pack(t, order), t.schema)

    run.__name__ = f"pack_roundtrip_{name}"
    run.__doc__ = f"{name} packed into batches, with checksums, and unpacked."
    query(f"SELECT * FROM {name}")(run)


for _name, _order in TABLES.items():
    _pack_query(_name, _order)


def _transform_query(kind: str, source: str, keys: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return packing.untransformed(packing.transformed(spread(table(spark, sf_dir, source).select(*keys, "text")), "text", kind, keys), keys)

    run.__name__ = f"{kind}_roundtrip"
    run.__doc__ = f"Every text of {source} through the {kind} transform and back."
    query(f"SELECT {', '.join(keys)}, text FROM {source}")(run)


for _kind in ("mtf", "lz", "huffman", "lz_huffman", "huffman_lz", "block", "auto"):
    _transform_query(_kind, "conversations" if _kind in ("mtf", "block", "huffman_lz") else "documents", ["conv_id", "turn"] if _kind in ("mtf", "block", "huffman_lz") else ["doc_id"])


def _step_query(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return packing.untransformed(packing.transformed(table(spark, sf_dir, "documents"), "text", kind, ["doc_id"]), ["doc_id"], kind)

    run.__name__ = f"{kind}_roundtrip"
    run.__doc__ = f"Every text through the single step {kind} and back."
    query("SELECT doc_id, text FROM documents")(run)


for _kind in packing.STEPS:
    _step_query(_kind)


@query("""WITH h AS (SELECT conv_id, turn, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM conversations), e AS (SELECT conv_id, turn, unnest(b) AS b, unnest(generate_series(0, len(b) - 1)) AS i FROM h)
    SELECT conv_id, turn, i // 256 AS block, string_agg(b, '' ORDER BY b, i) AS sorted_bytes, string_agg(printf('%02X', CAST(i % 256 AS INTEGER)), '' ORDER BY b, i) AS places FROM e GROUP BY ALL""")
def block_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of 256 bytes of every text in stable order, with the places that its bytes came from."""
    pairs = F.regexp_extract_all(F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), F.lit("(..)"), 1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", pairs.alias("p")).where(F.size("p") > 0)
    # A block never leaves its row: it is cut from the row's bytes and sorted there.
    blocks = rows.select("conv_id", "turn", "p", F.explode(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / 256).cast("int"))).alias("block"))
    one = F.slice("p", F.col("block") * 256 + 1, F.lit(256))
    s = blocks.select("conv_id", "turn", F.col("block").cast("bigint").alias("block"), F.array_sort(F.transform(one, lambda b, i: F.struct(b.alias("b"), i.alias("i")))).alias("s"))
    return s.select("conv_id", "turn", "block", F.array_join(F.transform("s", lambda x: x["b"]), "").alias("sorted_bytes"), F.array_join(F.transform("s", lambda x: F.lpad(F.hex(x["i"]), 2, "0")), "").alias("places"))


@query("""WITH h AS (SELECT role, hex(encode(coalesce(text, ''))) AS h FROM conversations), b AS (SELECT role, unnest(regexp_extract_all(h, '..')) AS b FROM h), n AS (SELECT role, b, count(*) AS n FROM b GROUP BY ALL)
    SELECT role, count(*) AS symbols, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(32768 AS BIGINT) AS kraft, true AS near_entropy, true AS prefix_free FROM n GROUP BY role""")
def huffman_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each role's codes: the Kraft sum in units of 2^-15, whether they take less than entropy and a bit for each byte, and whether none begins another."""
    h = profiles.byte_histogram(table(spark, sf_dir, "conversations"), "text", ["role"])
    total = h.groupBy("role").agg(F.sum("n").alias("total"))
    codes = packing.huffman_table(h, ["role"]).join(h, ["role", "byte"]).join(total, "role")
    ordered = codes.withColumn("after", F.lead("code").over(Window.partitionBy("role").orderBy("code")))
    bits = F.sum(F.col("bits") * F.col("n"))
    entropy = F.sum(F.col("n") * F.log2(F.col("total") / F.col("n")))
    out = ordered.groupBy("role").agg(F.count(F.lit(1)).alias("symbols"), F.sum("n").alias("n_bytes"), F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), 15 - F.col("bits"))).alias("kraft"), ((bits >= entropy - 1e-6) & (bits < entropy + F.sum("n"))).alias("near_entropy"), F.min(F.coalesce(~F.startswith("after", "code"), F.lit(True))).alias("prefix_free"))
    return out


@query("""SELECT doc_id, strlen(text) AS n_bytes, true AS smaller, true AS same FROM documents WHERE strlen(text) >= 2000""")
def lz_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of 2000 bytes and more: each is smaller after LZ, and comes back."""
    t = table(spark, sf_dir, "documents").where(F.octet_length("text") >= 2000).select("doc_id", "text")
    small = packing.transformed(t, "text", "lz", ["doc_id"])
    back = packing.untransformed(small, ["doc_id"])
    sizes = small.select("doc_id", F.length("payload").alias("packed"))
    return t.join(sizes, "doc_id").join(back.select("doc_id", F.col("text").alias("again")), "doc_id").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), (F.col("packed") < F.octet_length("text")).alias("smaller"), (F.col("text") == F.col("again")).alias("same"))


@query()
def huffman_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical codes for the bytes of each role's texts."""
    return packing.huffman_table(profiles.byte_histogram(table(spark, sf_dir, "conversations"), "text", ["role"]), ["role"])


@query("SELECT count(*) AS n, true AS all_read, true AS all_damage_seen FROM events")
def frame_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packed events are read; with one bit of each batch changed none is."""
    t = table(spark, sf_dir, "events")
    p = packing.pack(t, ["event_id"], compress="none")
    read = packing.unpack(p, t.schema).agg(F.count(F.lit(1)).alias("n"))
    flipped = F.unhex(F.concat(F.substring(F.hex("payload"), 1, 40), F.lpad(F.hex(F.conv(F.substring(F.hex("payload"), 41, 2), 16, 10).cast("int").bitwiseXOR(F.lit(1))), 2, "0"), F.expr("substring(hex(payload), 43)")))
    broken = packing.unpack(p.withColumn("payload", flipped), t.schema, mode="PERMISSIVE").agg(F.count(F.lit(1)).alias("left"))
    total = t.agg(F.count(F.lit(1)).alias("total"))
    one = F.lit(1)
    both = read.withColumn("k", one).join(broken.withColumn("k", one), "k").join(total.withColumn("k", one), "k")
    return both.select("n", (F.col("n") == F.col("total")).alias("all_read"), (F.col("left") == 0).alias("all_damage_seen"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def json_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, read again, packed as single records, and unpacked."""
    t = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    path = scratch_path(spark, "lines")
    json_source.write_lines(t, path)
    back = json_source.read_lines(spark, path, t.schema)
    return packing.unpack(packing.pack(back, ["event_id"], layout="rows", compress="lz"), t.schema)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def packed_source_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written and read by the data source."""
    t = table(spark, sf_dir, "orders")
    packed_source.register(spark)
    path = scratch_path(spark, "files")
    t.write.format("recordloom").mode("append").option("path", path).save()
    return spark.read.format("recordloom").schema(t.schema).option("path", path).option("split_bytes", 64 << 10).load()


@query("SELECT count(*) AS n, count(*) FILTER (event_id % 4 <> 0) AS good FROM events")
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which every fourth is cut short."""
    t = table(spark, sf_dir, "events")
    j = F.to_json(F.struct("event_id", "event_type"))
    lines = t.select(F.when(F.col("event_id") % 4 == 0, F.substring(j, 1, 12)).otherwise(j).alias("value"))
    return lines.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(1)).join(json_source.well_formed(lines).agg(F.count(F.lit(1)).alias("good")).withColumn("k", F.lit(1)), "k").drop("k")


@query("SELECT user_id, event_id, event_type, value FROM events")
def stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream: encoded with live dictionaries, compressed in a running window, and all the way back."""
    events = frames.read_pieces(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    record = F.to_json(F.struct("user_id", "event_id", "event_type", "value"))
    # Dictionaries start afresh now and then, within a micro-batch too.
    rows = events.select(F.pmod("user_id", F.lit(8)).alias("stream"), "event_id", record.alias("json"), (F.col("event_id") % 997 == 5).alias("afresh"))
    units = frames.encode_stream(rows, "stream", "event_id", reset="afresh")
    paths = [scratch_path(spark, x) for x in ("units", "units-state", "small", "small-state", "plain", "plain-state", "records", "records-state")]
    schema = "stream string, seq long, payload binary"

    def run(df: DataFrame, at: int) -> None:
        df.writeStream.format("parquet").option("path", paths[at]).option("checkpointLocation", paths[at + 1]).trigger(availableNow=True).start().awaitTermination()

    run(units, 0)
    run(frames.compress_stream(frames.read_pieces(spark, paths[0], schema)), 2)
    run(frames.decompress_stream(frames.read_pieces(spark, paths[2], schema)), 4)
    run(frames.decode_stream(frames.read_pieces(spark, paths[4], schema)), 6)
    back = spark.read.schema("stream string, at long, json string").parquet(paths[6])
    return back.select(F.from_json("json", "user_id bigint, event_id bigint, event_type string, value double").alias("r")).select("r.*")


@query("""WITH RECURSIVE p AS (SELECT user_id % 8 AS k, strlen(props) AS s, event_id % 1000 = 0 AS reset, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS place FROM events),
    r AS (SELECT k, place, reset, 0 AS seq, 1 AS n, s AS b FROM p WHERE place = 1 UNION ALL
      SELECT p.k, p.place, p.reset, r.seq + CASE WHEN r.n >= 410 OR r.b >= 4096 OR p.reset THEN 1 ELSE 0 END, CASE WHEN r.n >= 410 OR r.b >= 4096 OR p.reset THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 410 OR r.b >= 4096 OR p.reset THEN p.s ELSE r.b + p.s END
      FROM r JOIN p ON p.k = r.k AND p.place = r.place + 1)
    SELECT CAST(k AS VARCHAR) AS stream, CAST(seq AS BIGINT) AS seq, count(*) AS n, bool_or(reset) AS afresh FROM r GROUP BY k, seq""")
def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of an array stream: they end by number of records, by bytes, and before records that ask for a reset, which their flags tell."""
    events = frames.read_pieces(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    rows = events.select(F.pmod("user_id", F.lit(8)).alias("stream"), "event_id", F.col("props").alias("json"), (F.col("event_id") % 1000 == 0).alias("afresh"))
    units = frames.encode_stream(rows, "stream", "event_id", reset="afresh", rows=410, most=4096)
    path, state = scratch_path(spark, "frames"), scratch_path(spark, "frames-state")
    units.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema("stream string, seq long, n long, payload binary").parquet(path)
    return back.select("stream", "seq", "n", (packing.header(F.col("payload"), 5).bitwiseAND(F.lit(4)) != 0).alias("afresh"))


@query("SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 2 + 2 * len(json_keys(props)) ELSE 8 END AS INTEGER) AS symbols, CAST(0 AS INTEGER) AS flags FROM events")
def frame_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and flags of the frame that each event's object makes by itself."""
    j = F.when(F.col("event_id") % 3 == 0, F.lit('{"z": 1, "a": null}')).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.lit('{"b": [1], "k": 2}'))
    p = packing.framed(table(spark, sf_dir, "events").select("event_id", j.alias("j")), "j", ["event_id"])
    return p.select("event_id", packing.header(F.col("payload"), 6).alias("symbols"), packing.header(F.col("payload"), 5).alias("flags"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as one JSON document of many lines, read again."""
    t = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = scratch_path(spark, "document")
    t.agg(F.to_json(F.collect_list(F.struct("*")), {"pretty": "true"}).alias("value")).write.text(path)  # 25 rows by definition
    return json_source.read_json(spark, path, t.schema)


@query()
def ratio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, gzip and packed bytes of every table."""
    out = None
    for name, order in TABLES.items():
        t = table(spark, sf_dir, name)
        r = json_source.size_report(t, packing.pack(t, order)).select(F.lit(name).alias("table_name"), "*")
        out = r if out is None else out.unionAll(r)
    return out
