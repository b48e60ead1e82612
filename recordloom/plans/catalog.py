"""Registered queries for operators that SQL can express, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, text
from ..operators import profiles, sequences

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: A total order of lineitem: all its columns.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE = ", ".join(LINE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _b(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


_DELTA_SQL = "event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_ZZ = "CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END"
_VL = "CASE WHEN {u} < 128 THEN 1 WHEN {u} < 16384 THEN 2 WHEN {u} < 2097152 THEN 3 WHEN {u} < 268435456 THEN 4 WHEN {u} < 34359738368 THEN 5 WHEN {u} < 4398046511104 THEN 6 WHEN {u} < 562949953421312 THEN 7 WHEN {u} < 72057594037927936 THEN 8 ELSE 9 END"
_KIND = "CASE WHEN d IS NULL THEN 'first' WHEN d = 0 THEN 'zero' WHEN d = 1 THEN 'plus_one' WHEN d = -1 THEN 'minus_one' WHEN d BETWEEN -8 AND 7 THEN 'small' WHEN d BETWEEN -64 AND 63 THEN 'medium' ELSE 'large' END"


@query(f"""WITH e AS (SELECT user_id, ts, event_id, {_DELTA_SQL} AS d FROM events),
    t AS (SELECT {_KIND} AS kind, coalesce(d, event_id) AS d FROM e), s AS (SELECT kind, d, {_ZZ} AS u FROM t)
    SELECT kind, count(*) AS n, CAST(sum(CASE WHEN kind IN ('zero', 'plus_one', 'minus_one', 'small') THEN 1 WHEN kind = 'medium' THEN 2 ELSE 1 + {_VL.format(u='u')} END) AS BIGINT) AS bytes FROM s GROUP BY kind""")
def int_delta_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and bytes that the ids of each user's events take as deltas."""
    d = sequences.delta(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "event_id", ["user_id"], ["ts", "event_id"])
    kind = bits.delta_kind(F.col("delta"))
    size = F.when(F.col("delta").isNull(), 1 + bits.varint_length(bits.zigzag(F.col("event_id")))).otherwise(bits.delta_bytes(F.col("delta")))
    return d.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), _b(F.sum(size)).alias("bytes"))


@query("""WITH q AS (SELECT user_id, event_id, round_even((value - first_value(value) OVER w) * 65536, 0) AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, CAST(g - lag(g) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS delta FROM q""")
def float_delta_q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences.quantised_delta(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", ["user_id"], ["event_id"])
    return d.select("user_id", "event_id", _b("delta").alias("delta"))


@query("""WITH q AS (SELECT event_type, event_id, value AS v, first_value(value) OVER w AS v0 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
    g AS (SELECT *, round_even((v - v0) * 65536, 0) AS g FROM q), d AS (SELECT *, abs(g - lag(g) OVER (PARTITION BY event_type ORDER BY event_id)) AS d FROM g)
    SELECT event_type, count(*) AS n, max(abs(v0 + g / 65536 - v)) AS worst, max(abs(v0 + g / 65536 - v)) <= 1e-6 AND coalesce(max(d) < 2147483648, true) AS viable FROM d GROUP BY event_type""")
def float_viability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.viability(table(spark, sf_dir, "events"), "value", ["event_type"], ["event_id"]).select("event_type", "n", "worst", "viable")


@query("SELECT user_id, event_id FROM events")
def delta_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas and back."""
    d = sequences.delta(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "event_id", ["user_id"], ["ts", "event_id"], "d")
    d = d.withColumn("head", F.when(F.col("d").isNull(), F.col("event_id")))
    back = sequences.undelta(d.withColumnRenamed("event_id", "o"), "head", "d", ["user_id"], ["ts", "o"], "event_id")
    return back.select("user_id", "event_id")


_RUNS = """WITH r AS (SELECT {keys}, {value} AS v, row_number() OVER w AS place, {value} IS DISTINCT FROM lag({value}) OVER w OR row_number() OVER w = 1 AS c FROM {table} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
    s AS (SELECT *, sum(CAST(c AS INTEGER)) OVER (PARTITION BY {keys} ORDER BY place) - 1 AS run FROM r)"""


@query(f"""WITH e AS (SELECT *, l_linenumber - lag(l_linenumber) OVER w AS d, row_number() OVER w AS rn FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_linenumber, {_LINE})),
    r AS (SELECT l_suppkey, rn, d = 0 AS z, row_number() OVER (PARTITION BY l_suppkey ORDER BY rn) AS place FROM e WHERE d IS NOT NULL),
    c AS (SELECT *, CASE WHEN z IS DISTINCT FROM lag(z) OVER (PARTITION BY l_suppkey ORDER BY rn) OR place = 1 THEN 1 ELSE 0 END AS c FROM r),
    s AS (SELECT *, sum(c) OVER (PARTITION BY l_suppkey ORDER BY rn) AS run FROM c)
    SELECT l_suppkey, min(place) - 1 AS start, count(*) AS length FROM s WHERE z GROUP BY l_suppkey, run HAVING count(*) > 3""")
def zero_run_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("ln", F.col("l_linenumber"))
    return sequences.zero_runs(li, "l_linenumber", ["l_suppkey"], ["ln", *LINE]).select("l_suppkey", _b("start").alias("start"), "length")


_R = _RUNS.format(keys="user_id", value="event_type", table="events", order="event_id")


@query(_R + " SELECT user_id, CAST(run AS BIGINT) AS run, min(v) AS value, count(*) AS length FROM s GROUP BY user_id, run")
def value_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.runs(table(spark, sf_dir, "events"), F.col("event_type"), ["user_id"], ["event_id"]).select("user_id", _b("run").alias("run"), "value", "length")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS at, event_type AS value FROM events")
def value_rle_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.runs(table(spark, sf_dir, "events"), F.col("event_type"), ["user_id"], ["event_id"])
    return sequences.expand_runs(found, ["user_id"]).select("user_id", "at", "value")


_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus"]
_PROFILE = " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS column_name, count(*) AS n, count({c}) AS n_valid, count({c}) < count(*) AS has_nulls, count({c}) = 0 AS all_null, count({c}) = count(*) AND min({c}) = max({c}) AS constant, {str(c != 'l_linestatus').lower()} AS numeric FROM lineitem GROUP BY l_returnflag" for c in _NUM)


@query(_PROFILE)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile(table(spark, sf_dir, "lineitem"), _NUM, ["l_returnflag"]).drop("least", "most")


@query("SELECT o_orderstatus, 'o_custkey' AS column_name FROM orders GROUP BY o_orderstatus HAVING min(o_custkey) = max(o_custkey) AND count(o_custkey) = count(*) UNION ALL SELECT o_orderstatus, 'o_orderstatus2' FROM orders GROUP BY o_orderstatus")
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("o_orderstatus2", F.col("o_orderstatus"))
    return profiles.profile(o, ["o_custkey", "o_orderstatus2"], ["o_orderstatus"]).where("constant").select("o_orderstatus", "column_name")


_SKEWED = "CASE WHEN event_id % 10 < 7 THEN 'usual' ELSE event_type END"


@query(f"""WITH e AS (SELECT user_id, {_SKEWED} AS v FROM events), c AS (SELECT user_id, v, count(*) AS uses FROM e GROUP BY ALL), t AS (SELECT *, sum(uses) OVER (PARTITION BY user_id) AS n FROM c)
    SELECT user_id, v AS value, uses, CAST(n AS BIGINT) AS n FROM t WHERE n >= 8 AND uses * 10 >= n * 6""")
def mfv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.expr(_SKEWED).alias("value"))
    return profiles.most_frequent(e, "value", ["user_id"]).select("user_id", "value", "uses", _b("n").alias("n"))


@query(f"""WITH e AS (SELECT user_id, event_id, {_SKEWED} AS v FROM events), c AS (SELECT user_id, v, count(*) AS uses FROM e GROUP BY ALL), t AS (SELECT *, sum(uses) OVER (PARTITION BY user_id) AS n FROM c),
    m AS (SELECT user_id, v AS top FROM t WHERE n >= 8 AND uses * 10 >= n * 6), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM e)
    SELECT user_id, place AS at, v AS value FROM p JOIN m USING (user_id) WHERE v <> top""")
def mfv_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_SKEWED).alias("v"))
    return profiles.exceptions(e, "v", ["user_id"], ["event_id"]).select("user_id", _b("at").alias("at"), "value")


_HOLES = "SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events"


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


@query(f"""WITH h AS ({_HOLES}), p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM h),
    b AS (SELECT user_id, place // 8 AS byte_at, sum(CASE WHEN value IS NULL THEN 0 ELSE 1 << CAST(place % 8 AS INTEGER) END) AS byte FROM p GROUP BY ALL)
    SELECT user_id, string_agg(printf('%02X', CAST(byte AS INTEGER)), '' ORDER BY byte_at) AS bitmap FROM b GROUP BY user_id""")
def null_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.bitmap_hex(_holes(spark, sf_dir), F.col("value").isNotNull(), ["user_id"], ["event_id"])


@query(f"WITH h AS ({_HOLES}) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS at, value IS NOT NULL AS valid FROM h")
def validity_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of the bitmaps, by place."""
    h = _holes(spark, sf_dir)
    maps = profiles.bitmap_hex(h, F.col("value").isNotNull(), ["user_id"], ["event_id"])
    sizes = h.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    at = maps.join(sizes, "user_id").select("user_id", "bitmap", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("at"))
    return at.select("user_id", "at", profiles.is_set(F.col("bitmap"), F.col("at")).alias("valid"))


@query(f"WITH h AS ({_HOLES}) SELECT user_id, event_id, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS filled FROM h")
def null_fill_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.fill_forward(_holes(spark, sf_dir), "value", ["user_id"], ["event_id"]).select("user_id", "event_id", "filled")


@query(f"WITH h AS ({_HOLES}) SELECT user_id, event_id, coalesce(value, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS filled FROM h")
def null_fill_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.fill_first(_holes(spark, sf_dir), "value", ["user_id"], ["event_id"]).select("user_id", "event_id", "filled")


@query(f"WITH h AS ({_HOLES}) SELECT user_id, event_id, coalesce(value, 0.0) AS value FROM h")
def null_fill_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.fill_default(_holes(spark, sf_dir), ["value"])


@query(f"""WITH e AS (SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER w AS d, row_number() OVER w AS rn FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINE})),
    p AS (SELECT l_orderkey, d + 8 AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY rn) - 1 AS place FROM e WHERE d IS NOT NULL),
    b AS (SELECT l_orderkey, place // 2 AS i, CAST(sum(h * CASE WHEN place % 2 = 0 THEN 16 ELSE 1 END) AS INTEGER) AS b FROM p GROUP BY ALL)
    SELECT l_orderkey, string_agg(printf('%02X', b), '' ORDER BY i) AS packed FROM b GROUP BY l_orderkey""")
def bitpack4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences.delta(table(spark, sf_dir, "lineitem").select(*LINE), "l_linenumber", ["l_orderkey"], LINE, "d")
    return profiles.nibbles(d.where("d is not null"), "d", ["l_orderkey"], LINE)


_QTY = f"""WITH e AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) - lag(CAST(l_quantity AS BIGINT)) OVER w AS d, row_number() OVER w AS rn FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {_LINE})),
    z AS (SELECT l_suppkey, rn, d, {_ZZ} AS u FROM e WHERE d IS NOT NULL),
    k AS (SELECT l_suppkey, CASE WHEN max(abs(d)) = 0 THEN 2 ELSE greatest(0, least(7, length(bin(max(abs(d)))) - 2)) END AS rice_k FROM z GROUP BY l_suppkey)"""


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE).withColumn("q", F.col("l_quantity").cast("bigint"))


@query(_QTY + " SELECT l_suppkey, CAST(rice_k AS INTEGER) AS rice_k, CAST(ceil(sum((u >> CAST(rice_k AS INTEGER)) + 1 + rice_k) / 8.0) + 1 AS BIGINT) AS rice_bytes FROM z JOIN k USING (l_suppkey) GROUP BY l_suppkey, rice_k")
def rice_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = profiles.costs(_quantities(spark, sf_dir), "q", ["l_suppkey"], LINE)
    return c.select("l_suppkey", F.col("rice_k").cast("int").alias("rice_k"), _b("rice_bytes").alias("rice_bytes"))


@query(_QTY + " SELECT l_suppkey, CAST(rice_k AS INTEGER) AS rice_k, string_agg(repeat('0', CAST(u >> CAST(rice_k AS INTEGER) AS INTEGER)) || '1' || CASE WHEN rice_k > 0 THEN lpad(bin(u % (1 << CAST(rice_k AS INTEGER))), CAST(rice_k AS INTEGER), '0') ELSE '' END, '' ORDER BY rn) AS bit_text FROM z JOIN k USING (l_suppkey) GROUP BY l_suppkey, rice_k")
def rice_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = profiles.rice_stream(_quantities(spark, sf_dir), "q", ["l_suppkey"], LINE)
    return r.select("l_suppkey", F.col("rice_k").cast("int").alias("rice_k"), "bit_text")


_CHOICE = """WITH e AS (SELECT {key} AS key, CAST({value} AS BIGINT) - lag(CAST({value} AS BIGINT)) OVER w AS d, row_number() OVER w AS rn FROM {table} WINDOW w AS (PARTITION BY {key} ORDER BY {order})),
    z AS (SELECT key, rn, d, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS u FROM e WHERE d IS NOT NULL),
    c AS (SELECT *, CASE WHEN d = 0 AND lag(d) OVER (PARTITION BY key ORDER BY rn) = 0 THEN 0 ELSE 1 END AS c FROM z),
    r AS (SELECT *, sum(c) OVER (PARTITION BY key ORDER BY rn) AS run FROM c),
    b AS (SELECT key, run, count(*) AS len, bool_and(d = 0) AS zero FROM r GROUP BY key, run),
    rle AS (SELECT key, sum(CASE WHEN zero AND len > 3 THEN 2 + CAST(len > 127 AS INTEGER) WHEN zero THEN len ELSE 1 END) AS rle FROM b GROUP BY key),
    a AS (SELECT key, count(*) AS n, bool_and(d BETWEEN -8 AND 7) AS small, max(abs(d)) AS top, CASE WHEN max(abs(d)) = 0 THEN 2 ELSE greatest(0, least(7, length(bin(max(abs(d)))) - 2)) END AS k FROM z GROUP BY key),
    s AS (SELECT key, ceil(sum((u >> CAST(k AS INTEGER)) + 1 + k) / 8.0) + 1 AS rice FROM z JOIN a USING (key) GROUP BY key)
    SELECT '{name}' AS column_name, key, n, small AS all_small, top, CAST(n // 2 + 5 AS BIGINT) AS bitpack_bytes, CAST(rle AS BIGINT) AS rle_bytes, CAST(rice AS BIGINT) AS rice_bytes,
           CASE WHEN small AND NOT rle < 0.8 * (n / 2 + 5) THEN 'bitpack' WHEN n >= 10 AND top < 1024 AND rice < 1.5 * n THEN 'rice' ELSE 'tokens' END AS codec
    FROM a JOIN rle USING (key) JOIN s USING (key)"""
_CHOSEN = [("l_linenumber", "lineitem", "l_suppkey", "l_linenumber", LINE), ("l_quantity", "lineitem", "l_suppkey", "l_quantity", LINE), ("l_partkey", "lineitem", "l_suppkey", "l_partkey", LINE), ("event_id", "events", "user_id", "event_id", ["event_id"]), ("p_size", "part", "p_retailprice", "p_size", ["p_partkey"])]


@query(" UNION ALL ".join(f"SELECT * FROM ({_CHOICE.format(name=n, table=t, key=f'CAST({k} AS VARCHAR)' if k != 'p_retailprice' else 'p_brand', value=v, order=', '.join(o))})" for n, t, k, v, o in _CHOSEN))
def codec_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for source, key in dict.fromkeys((t, k) for _, t, k, _, _ in _CHOSEN):
        of = [x for x in _CHOSEN if x[1:3] == (source, key)]
        t = table(spark, sf_dir, source).withColumn("key", F.col("p_brand" if key == "p_retailprice" else key).cast("string"))
        long = profiles.long_form(t, [x[3] for x in of], ["key"], of[0][4])
        c = profiles.costs(long, "v", ["key", "column_name"], ["at"]).select("column_name", "key", "n", "all_small", "top", _b("bitpack_bytes").alias("bitpack_bytes"), _b("rle_bytes").alias("rle_bytes"), _b("rice_bytes").alias("rice_bytes"), "codec")
        out = c if out is None else out.unionAll(c)
    return out


_JSON = "CASE WHEN event_id % 3 = 0 THEN '{\"z\": 1, \"a\": null}' WHEN event_id % 3 = 1 THEN props ELSE '{\"b\": [1], \"k\": 2}' END"


@query(f"""WITH j AS (SELECT user_id, event_id, json_keys({_JSON}) AS ks FROM events), u AS (SELECT user_id, event_id, unnest(ks) AS field, unnest(generate_series(1, len(ks))) AS pos FROM j),
    f AS (SELECT user_id, field, min(event_id * 1000 + pos) AS first FROM u GROUP BY ALL)
    SELECT user_id, field, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS field_at FROM f""")
def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_JSON).alias("json"))
    return profiles.schema_union(e, "json", ["event_id"], ["user_id"]).select("user_id", "field", _b("field_at").alias("field_at"))


@query("WITH p AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place FROM part), f AS (SELECT p_brand, p_name AS value, min(place) AS first_at, count(*) AS uses FROM p GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY first_at) - 1 AS slot FROM f")
def dict_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sequences.first_seen(table(spark, sf_dir, "part"), "p_name", ["p_brand"], ["p_partkey"])
    return f.select("p_brand", "value", _b("first_at").alias("first_at"), "uses", _b("slot").alias("slot"))


@query(f"""WITH r AS (SELECT l_suppkey, l_partkey AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE}) - 1 AS place FROM lineitem),
    b AS (SELECT *, lag(place) OVER (PARTITION BY l_suppkey, v ORDER BY place) AS before, lead(place) OVER (PARTITION BY l_suppkey, v ORDER BY place) AS after FROM r),
    c AS (SELECT x.l_suppkey, x.place, count(y.place) AS n FROM b x JOIN b y ON y.l_suppkey = x.l_suppkey AND y.place > x.before AND y.place < x.place AND (y.after IS NULL OR y.after >= x.place) GROUP BY ALL)
    SELECT b.l_suppkey, b.place AS at, b.v AS value, b.before IS NOT NULL AND coalesce(c.n, 0) < 64 AS hit FROM b LEFT JOIN c ON b.l_suppkey = c.l_suppkey AND b.place = c.place""")
def lru_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.lru_hits(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_suppkey"], LINE, 64)


@query("""WITH v AS (SELECT doc_id, list_transform(range(0, 13), lambda i: ((doc_id * 7919) >> CAST(i AS INTEGER)) & (CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 7 END)) AS b FROM documents),
    w AS (SELECT *, CASE WHEN list_max(b) <= 1 THEN 1 WHEN list_max(b) <= 3 THEN 2 ELSE 8 END AS width FROM v)
    SELECT doc_id, CAST(width AS INTEGER) AS width, array_to_string(list_transform(range(0, CAST(ceil(13 * width / 8.0) AS BIGINT)), lambda g: printf('%02X', CAST(list_sum(list_transform(b[g * (8 // width) + 1 : (g + 1) * (8 // width)], lambda x, j: x << CAST((j - 1) * width AS INTEGER))) AS BIGINT))), '') AS packed FROM w""")
def binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of small numbers made of ids, with as many bits for each as they need."""
    mask = F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 3).otherwise(7)
    b = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.call_function("shiftright", F.col("doc_id") * 7919, i).bitwiseAND(mask.cast("bigint")))
    t = table(spark, sf_dir, "documents").select("doc_id", b.alias("b")).withColumn("width", bits.byte_width(F.col("b")))
    return t.select("doc_id", "width", bits.packed_hex(F.col("b"), F.col("width")).alias("packed"))


@query("""WITH RECURSIVE r AS (SELECT o_custkey % 50 AS k, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS p, CAST(floor(o_totalprice) AS BIGINT) % 100 AS v FROM orders),
    s(k, p, v, hit, slot, held, used) AS (SELECT k, p, v, false, CAST(0 AS BIGINT), [v], [v] FROM r WHERE p = 0 UNION ALL
      SELECT r.k, r.p, r.v, list_contains(held, r.v), CASE WHEN list_contains(held, r.v) THEN list_position(held, r.v) - 1 WHEN len(held) < 64 THEN len(held) ELSE list_position(held, used[1]) - 1 END,
        CASE WHEN list_contains(held, r.v) THEN held WHEN len(held) < 64 THEN list_append(held, r.v) ELSE list_transform(held, lambda x: CASE WHEN x = used[1] THEN r.v ELSE x END) END,
        CASE WHEN list_contains(held, r.v) THEN list_append(list_filter(used, lambda x: x <> r.v), r.v) WHEN len(held) < 64 THEN list_append(used, r.v) ELSE list_append(used[2:], r.v) END
      FROM s JOIN r ON r.k = s.k AND r.p = s.p + 1)
    SELECT k, CAST(p AS BIGINT) AS at, v AS value, hit, CAST(slot AS INTEGER) AS slot FROM s""")
def lru_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a dictionary that is full and replaces values."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), "o_orderkey", (F.floor("o_totalprice") % 100).alias("v"))
    return sequences.lru_slots(o, "v", ["k"], ["o_orderkey"], 64)


@query("""SELECT c_custkey, CAST(greatest(-32768, least(32767, round_even(c_acctbal * 256, 0))) AS BIGINT) AS f16, CAST(greatest(-2147483648, least(2147483647, round_even(c_acctbal * 65536, 0))) AS BIGINT) AS f32,
    greatest(-2147483648, least(2147483647, round_even(c_acctbal * 65536, 0))) / 65536.0 AS back FROM customer""")
def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    f32 = bits.fixed(F.col("c_acctbal"), 65536, 32)
    return c.select("c_custkey", bits.fixed(F.col("c_acctbal"), 256, 16).alias("f16"), f32.alias("f32"), (bits.from_little_endian_hex(bits.little_endian_hex(f32, 4), 4) / 65536.0).alias("back"))


_V = "o_orderkey * 1299709"
_VU = f"({_V})"


@query(f"""WITH o AS (SELECT o_orderkey, {_V} AS u, {_VL.format(u=_VU)} AS n FROM orders)
    SELECT o_orderkey, CAST(n AS INTEGER) AS n_bytes, list_aggregate(list_transform(generate_series(0, n - 1), lambda i: printf('%02X', CAST((u >> CAST(7 * i AS INTEGER)) % 128 + CASE WHEN i < n - 1 THEN 128 ELSE 0 END AS INTEGER))), 'string_agg', '') AS varint, u AS back, 2 * u AS zigzagged, -u AS unzigzagged FROM o""")
def varint_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.expr(_V)
    h = bits.varint_hex(u)
    return table(spark, sf_dir, "orders").select("o_orderkey", bits.varint_length(u).alias("n_bytes"), h.alias("varint"), bits.varint_from_hex(h).alias("back"), bits.zigzag(u).alias("zigzagged"), bits.unzigzag(bits.zigzag(-u)).alias("unzigzagged"))


@query("""WITH t AS (SELECT DISTINCT event_id % 256 AS b FROM events) SELECT b AS token, CASE WHEN b < 64 THEN 'field' WHEN b < 128 THEN 'string' WHEN b < 192 THEN 'mac' WHEN b BETWEEN 195 AND 210 THEN 'small_delta' ELSE 'other' END AS kind,
    CAST(CASE WHEN b BETWEEN 195 AND 210 THEN b - 203 END AS BIGINT) AS small_delta, CAST(b % 64 AS BIGINT) AS slot FROM t""")
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select((F.col("event_id") % 256).alias("token")).distinct()
    b = F.col("token")
    return t.select("token", bits.token_kind(b).alias("kind"), _b(bits.small_delta_of(b)).alias("small_delta"), _b(bits.dictionary_slot(b)).alias("slot"))


_MACQ = "array_to_string(list_transform(generate_series(0, 5), lambda i: substr(printf('%012X', event_id * 2654435 % 281474976710656), CAST(2 * i + 1 AS INTEGER), 2)), ':')"


@query(f"""WITH m AS (SELECT event_id, {_MACQ} AS mac, printf('%012X', event_id * 2654435 % 281474976710656) AS bytes FROM events),
    r AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN mac ELSE lower(replace(mac, ':', '-')) END AS raw FROM m), t AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN substr(raw, 1, 16) ELSE raw END AS cut FROM r),
    v AS (SELECT *, regexp_full_match(cut, '([0-9A-Fa-f][0-9A-Fa-f][:-])*[0-9A-Fa-f][0-9A-Fa-f]') AND length(cut) = 17 AS valid FROM t)
    SELECT event_id, CASE WHEN valid THEN mac END AS mac, valid, regexp_full_match(raw || '0', '([0-9A-Fa-f][0-9A-Fa-f][:-])*[0-9A-Fa-f][0-9A-Fa-f]') AS other_valid, CASE WHEN valid THEN bytes END AS bytes FROM v""")
def mac_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of ids, written with either separator and case, some cut short, parsed and formatted."""
    h = F.lpad(F.hex(F.expr("event_id * 2654435 % 281474976710656")), 12, "0")
    mac = F.when(F.col("event_id") % 2 == 0, F.regexp_replace(h, "(..)(?!$)", "$1:")).otherwise(F.lower(F.regexp_replace(h, "(..)(?!$)", "$1-")))
    cut = F.when(F.col("event_id") % 7 == 0, F.substring(mac, 1, 16)).otherwise(mac)
    parsed = text.parse_mac(cut)
    return table(spark, sf_dir, "events").select("event_id", text.format_mac(parsed).alias("mac"), text.is_mac(cut).alias("valid"), text.is_mac(F.concat(mac, F.lit("0"))).alias("other_valid"), F.hex(parsed).alias("bytes"))


@query("SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, CAST(length(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g')) AS BIGINT) AS n_ascii, md5(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g')) AS ascii_md5 FROM documents")
def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", _b(text.utf8_length(t)).alias("n_bytes"), _b(F.length(text.ascii_only(t))).alias("n_ascii"), F.md5(text.ascii_only(t).cast("binary")).alias("ascii_md5"))


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 128 AS chunk FROM events")
def array_stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.chunks(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])


@query("""WITH RECURSIVE p AS (SELECT role, conv_id, turn, strlen(text) AS s, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS place FROM conversations),
    r AS (SELECT role, place, conv_id, turn, 0::BIGINT AS chunk, CASE WHEN coalesce(s, 0) >= 4096 THEN 0 ELSE 1 END AS n, CASE WHEN coalesce(s, 0) >= 4096 THEN 0 ELSE coalesce(s, 0) END AS b, coalesce(s, 0) >= 4096 AS full_ FROM p WHERE place = 1
      UNION ALL SELECT p.role, p.place, p.conv_id, p.turn, r.chunk + CAST(r.full_ AS BIGINT), CASE WHEN r.n + 1 >= 128 OR r.b + coalesce(p.s, 0) >= 4096 THEN 0 ELSE r.n + 1 END, CASE WHEN r.n + 1 >= 128 OR r.b + coalesce(p.s, 0) >= 4096 THEN 0 ELSE r.b + coalesce(p.s, 0) END, r.n + 1 >= 128 OR r.b + coalesce(p.s, 0) >= 4096 FROM r JOIN p ON p.role = r.role AND p.place = r.place + 1)
    SELECT role, conv_id, turn, chunk FROM r""")
def byte_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return sequences.byte_chunks(c, F.octet_length("text"), ["role"], ["conv_id", "turn"])


@query("""WITH w AS (SELECT event_type, user_id, event_id, value, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS before FROM events)
    SELECT event_id, CASE WHEN before IS NULL THEN CASE WHEN value BETWEEN -128 AND 127 THEN 'fixed16' ELSE 'fixed32' END WHEN round_even((value - before) * 256, 0) BETWEEN -8 AND 7 THEN 'small' ELSE 'large' END AS kind,
    CAST(CASE WHEN before IS NULL THEN CASE WHEN value BETWEEN -128 AND 127 THEN round_even(value * 256, 0) ELSE round_even(value * 65536, 0) END ELSE round_even((value - before) * 256, 0) END AS BIGINT) AS stored FROM w""")
def field_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences.field_deltas(table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value"), "event_type", "value", ["event_id"], ["user_id"])
    return d.select("event_id", "kind", "stored")


@query("""WITH w AS (SELECT event_type, user_id, event_id, value, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS before FROM events)
    SELECT event_id, event_id AS whole, sum(CASE WHEN before IS NOT NULL THEN round_even((value - before) * 256, 0) / 256 WHEN value BETWEEN -128 AND 127 THEN round_even(value * 256, 0) / 256 ELSE round_even(value * 65536, 0) / 65536 END)
    OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS value FROM w""")
def field_deltas_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers come back as they were, doubles on their grids."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value", F.col("event_id").alias("o"))
    at = dict(field="event_type", order=["o"], keys=["user_id"])
    d = sequences.field_values(sequences.field_deltas(e, value="event_id", **at).drop("event_id"), integers=True, out="whole", **at).drop("kind", "stored")
    d = sequences.field_values(sequences.field_deltas(d, value="value", **at).drop("value"), **at)
    return d.select(F.col("o").alias("event_id"), "whole", "value")


@query("WITH h AS (SELECT role, hex(encode(coalesce(text, ''))) AS h FROM conversations), b AS (SELECT role, unnest(regexp_extract_all(h, '..')) AS b FROM h) SELECT role, CAST(('0x' || b)::INTEGER AS INTEGER) AS byte, count(*) AS n FROM b GROUP BY ALL")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.byte_histogram(table(spark, sf_dir, "conversations"), "text", ["role"])


@query("WITH h AS (SELECT doc_id, regexp_extract_all(substr(hex(encode(coalesce(text, ''))), 1, 2048), '..') AS b FROM documents) SELECT doc_id, CAST(len(list_distinct(b)) AS BIGINT) AS kinds, CAST(len(b) AS BIGINT) AS looked_at, len(b) > 0 AND len(list_distinct(b)) / len(b) > 0.8 AS stored FROM h")
def entropy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = profiles.entropy_gate(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return g.select("doc_id", _b("kinds").alias("kinds"), _b("looked_at").alias("looked_at"), F.coalesce("stored", F.lit(False)).alias("stored"))


@query("""WITH j AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN event_id || '.5e1' WHEN 2 THEN CAST(event_id AS VARCHAR) WHEN 3 THEN CAST(to_json(event_type) AS VARCHAR) ELSE 'null' END AS j FROM events)
    SELECT event_id, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' ELSE 'int' END AS kind FROM j""")
def value_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.when(F.col("event_id") % 5 == 0, F.col("props")).when(F.col("event_id") % 5 == 1, F.concat(F.col("event_id").cast("string"), F.lit(".5e1"))).when(F.col("event_id") % 5 == 2, F.col("event_id").cast("string")).when(F.col("event_id") % 5 == 3, F.to_json(F.struct("event_type")).substr(15, 100)).otherwise("null")
    return table(spark, sf_dir, "events").select("event_id", text.json_kind(F.regexp_replace(j, r"\}$", "")).alias("kind"))
