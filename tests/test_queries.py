"""Registered queries against DuckDB on the smallest tables, and the operators on edge cases."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordloom.functions import bits, text
from recordloom.operators import packing, profiles, sequences
from recordloom.plans import registry
from recordloom.sources import json as json_source
from recordloom.sources import packed as packed_source

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(df: pd.DataFrame) -> list:
    def cell(v):
        if hasattr(v, "tolist"):
            return repr(v.tolist())
        if isinstance(v, float):
            return repr(round(v, 9))
        return "null" if v is None or v is pd.NaT or v is pd.NA else str(v)

    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toArrow().to_pandas(types_mapper=pd.ArrowDtype)
    want = duck.sql(registry.oracle_sql()[name]).to_arrow_table().to_pandas(types_mapper=pd.ArrowDtype)
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_integers_at_the_ends_of_a_long(spark):
    v = [0, 1, -1, 127, 128, 2**31, -(2**31) - 1, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    back = [r.b for r in df.select(bits.unzigzag(bits.zigzag(F.col("v"))).alias("b")).collect()]
    assert back == v
    n = [r.n for r in df.select(bits.varint_length(bits.zigzag(F.col("v"))).alias("n")).collect()]
    assert n == [1, 1, 1, 2, 2, 5, 5, 10, 10]


def test_addresses(spark):
    rows = ["AA:BB:cc:00:11:22", "AA-BB-CC-00-11-22", "AA:BB:CC:00:11:2", "AA:BB:CC:00:11:22\n", "", None, "aabbcc001122"]
    df = spark.createDataFrame([(x,) for x in rows], "s string").select(text.is_mac(F.col("s")).alias("m"), text.format_mac(text.parse_mac(F.col("s"))).alias("f"))
    assert [(r.m, r.f) for r in df.collect()] == [(True, "AA:BB:CC:00:11:22"), (True, "AA:BB:CC:00:11:22"), (False, None), (False, None), (False, None), (None, None), (False, "AA:BB:CC:00:11:22")]


def test_lru_hits_against_a_list(spark):
    import random

    rng = random.Random(2)
    values = [rng.choice("abcdefghij") for _ in range(300)]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "k int, at0 int, v string")
    got = {r.at: r.hit for r in sequences.lru_hits(df, "v", ["k"], ["at0"], slots=4).collect()}
    held: list = []
    for i, v in enumerate(values):
        assert got[i] == (v in held), i
        held = [v, *(x for x in held if x != v)][:4]


def test_empty_and_null_columns(spark):
    empty = spark.createDataFrame([], "k int, i int, v long")
    assert profiles.costs(empty, "v", ["k"], ["i"]).count() == 0
    assert packing.unpack(packing.pack(empty, ["i"]), empty.schema).count() == 0
    nulls = spark.createDataFrame([(1, 1, None), (1, 2, None)], "k int, i int, v long")
    assert packing.unpack(packing.pack(nulls, ["i"]), nulls.schema).collect() == nulls.collect()
    p = profiles.profile(nulls, ["v"], ["k"]).first()
    assert p.all_null and p.has_nulls and not p.constant
    assert profiles.fill_forward(nulls, "v", ["k"], ["i"]).where("filled is not null").count() == 0


def test_types_come_back(spark):
    df = spark.sql("""select 1 as i, cast(2.5 as float) as f, cast('nan' as double) as d, cast(1.10 as decimal(9,2)) as m, date'2020-02-29' as t, timestamp'1999-01-01 00:00:00' as ts,
        binary('x') as b, array(1, null) as a, named_struct('x', 1, 'y', array('q')) as s, true as o, cast(null as string) as n union all
        select null, null, null, null, null, null, null, null, null, null, 'z'""")
    for layout in ("batch",):
        got = packing.unpack(packing.pack(df, ["i"], layout=layout), df.schema)
        assert got.schema == df.schema
        assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))


def test_pruned_columns_and_bad_batches(spark):
    df = spark.range(10).withColumn("s", F.lit("x"))
    p = packing.pack(df, ["id"], batch_rows=3)
    assert packing.unpack(p, df.schema, columns=["s"]).columns == ["s"]
    bad = p.withColumn("payload", F.lit(b"broken"))
    assert packing.unpack(bad, df.schema, mode="PERMISSIVE").count() == 0
    with pytest.raises(Exception, match="no frame|unknown transform|FormatError"):
        packing.unpack(bad, df.schema).collect()


def test_source_overwrites_and_reads_nothing(spark, tmp_path):
    packed_source.register(spark)
    df = spark.range(20).withColumnRenamed("id", "a")
    path = str(tmp_path / "p")
    for mode in ("overwrite", "overwrite"):
        df.write.format("recordloom").mode(mode).option("path", path).save()
    back = spark.read.format("recordloom").schema(df.schema).option("path", path).load()
    assert sorted(r.a for r in back.collect()) == list(range(20))
    none = spark.read.format("recordloom").schema(df.schema).option("path", str(tmp_path / "none")).load()
    assert none.count() == 0


def test_source_cuts_files_at_units(spark, tmp_path):
    packed_source.register(spark)
    df = spark.range(5000).select(F.col("id").alias("a"), F.concat(F.lit("row "), F.col("id")).alias("s")).coalesce(1)
    path = f"file://{tmp_path}/p"
    df.write.format("recordloom").mode("append").option("path", path).option("batch_rows", 100).save()
    read = spark.read.format("recordloom").schema("a long, s string").option("path", path)
    for split, least in ((1, 50), (4000, 4), (1 << 30, 1)):
        back = read.option("split_bytes", split).load()
        assert back.rdd.getNumPartitions() >= least and (split > 1 or back.rdd.getNumPartitions() == 50)
        assert sorted((r.a, r.s) for r in back.collect()) == [(i, f"row {i}") for i in range(5000)]
    some = spark.read.format("recordloom").schema("s string").option("path", path).load()
    assert some.columns == ["s"] and some.count() == 5000
    # A file without an index is one range; a damaged unit is an error, or passed over.
    file = next((tmp_path / "p").glob("*.loom"))
    data = file.read_bytes()
    end = len(data) - 16 - int.from_bytes(data[-16:-8], "little") - 1
    file.write_bytes(data[:end])
    assert read.load().rdd.getNumPartitions() == 1 and read.load().count() == 5000
    file.write_bytes(data[:1000] + bytes([data[1000] ^ 1]) + data[1001:])
    with pytest.raises(Exception):
        read.load().collect()
    assert read.option("mode", "PERMISSIVE").load().count() == 4900


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    from pyspark.sql.types import StructType

    schema = StructType().add("a", "long")
    assert sorted(r.a for r in json_source.read_lines(spark, str(tmp_path / "a.jsonl"), schema, "DROPMALFORMED").collect()) == [1, 2]
    with pytest.raises(Exception):
        json_source.read_lines(spark, str(tmp_path / "a.jsonl"), schema).collect()
    (tmp_path / "b.json").write_text('[{"a": 1},\n {"b": "x"}]')
    assert json_source.read_json(spark, str(tmp_path / "b.json")).columns == ["a", "b"]


def test_command_line(spark, tmp_path):
    from recordloom import cli

    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    cli.main(["encode", str(tmp_path / "a.jsonl"), str(tmp_path / "p"), "--stats"])
    cli.main(["decode", str(tmp_path / "p"), str(tmp_path / "j")])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":1,"b":"x"}', '{"a":2}']
    cli.main(["decode", str(tmp_path / "p"), str(tmp_path / "q"), "--pretty"])
    assert spark.read.text(str(tmp_path / "q")).count() > 2


def test_huffman_table_is_a_full_code(spark):
    t = registry.queries()["huffman_codes"](spark, SF).groupBy("role").agg(F.sum(F.pow(F.lit(2.0), -F.col("bits"))).alias("kraft"), F.count("code").alias("n"), F.countDistinct("code").alias("d")).collect()
    assert t and all(r.kraft == 1.0 and r.n == r.d for r in t)


def test_field_deltas_of_integers_and_gaps(spark):
    rows = [("a", i, v, f) for i, (v, f) in enumerate([(2**62, 1.5), (2**62 + 7, None), (2**62 - 1, 300.25), (None, 300.5), (5, -4.0), (-9, -4.0)])] + [("b", 0, None, None), ("b", 1, 3, 128.0)]
    d = spark.createDataFrame(rows, "f string, o int, whole long, value double")
    whole = sequences.field_deltas(d, "f", "whole", ["o"])
    assert [(r.kind, r.stored) for r in whole.where("f = 'a'").orderBy("o").collect()] == [("int", 2**62), ("small", 7), ("small", -8), ("large", None), ("int", 5), ("large", -14)]
    back = sequences.field_values(whole, "f", ["o"], integers=True, out="back").collect()
    assert all(r.back == r.whole for r in back) and len(back) == 8
    back = sequences.field_values(sequences.field_deltas(d, "f", "value", ["o"]), "f", ["o"], out="back").collect()
    assert all(r.back == r.value for r in back) and len(back) == 8
