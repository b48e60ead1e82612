"""The packed format against hand-assembled frames, round trips and damaged bytes."""

import math
import random
import struct

import numpy as np
import pytest

from recordloom.codec import transforms, wire

VECTORS = {
    "504B5231010005E90201D5016102C002E75EB1FAC3": [{"a": 1}, {"a": 2}],
    "504B5231010009E90202D501610AD501620C01C002E602D40178E501C908AF01": [{"a": 1}, {"b": "x"}],
    "504B5231010005E90801D5016102C000EB07A7A7A7A085E91A07": [{"a": v} for v in (0, 2, 1, 3, 2, 4, 3, 5)],
    "504B5231010005E90B01D5016102C000ED0A03040201008040201008040200979498F1": [{"a": v} for v in range(0, 201, 20)],
}


@pytest.mark.parametrize("frame", VECTORS)
def test_vectors(frame):
    records = VECTORS[frame]
    assert wire.encode_records(records).hex().upper() == frame
    assert wire.decode(bytes.fromhex(frame)) == records


def test_single_object_vector():
    raw = "504B5231010004DCD50161D7DD00C883E0"
    assert wire.encode({"a": True}).hex().upper() == raw
    assert wire.decode(bytes.fromhex(raw)) == [{"a": True}]


def _frame(items: bytes) -> bytes:
    return wire.Encoder().frame(items)


def test_items_that_are_only_read():
    x = wire.decode
    assert x(_frame(bytes([0xC1, 0x80, 0x01]))) == [1.5]
    assert x(_frame(bytes([0xC2, 0x00, 0x80, 0x01, 0x00]))) == [1.5]
    assert x(_frame(bytes([0xE3, 2, 1, 0xD5, 1, 97, 0xC0, 2, 0xD7]))) == [{"a": 1}, {"a": True}]
    assert x(_frame(bytes([0xE4, 3, 1, 0xD5, 1, 97, 0xC0, 2, 0xE5, 2]))) == [{"a": 1}] * 3
    assert x(_frame(bytes([0xEF]) + bytes([0xF0, 1, 1, 0xD5, 1, 97, 1, 0xC0, 2]) + bytes([0xDB]))) == [{"a": 1}]
    assert x(_frame(bytes([0xF4, 3, 0b101]))) == [b"\x01\x00\x01"]
    assert x(_frame(bytes([0xF5, 3, 0b100111]))) == [b"\x03\x01\x02"]


def _same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert wire.same(dict(sorted((k, v) for k, v in x.items() if v is not None)), dict(sorted(y.items()))), (x, y)


EDGES = [
    [{"a": v} for v in (2147483647, 2147483648, -2147483649, 1700000000000, 2**41, 2**63 - 1, -(2**63))],
    [{"a": v} for v in (0.5, 40000.25, 0.1)],
    [{"a": v} for v in (math.nan, math.inf, -math.inf, -0.0, 0.0)],
    [{"a": {"x": 1}}, {"a": {"x": 1}}],
    [{"a": 1}, {"a": True}, {"a": 1.0}],
    [{"a": 2.0}, {"a": 3.0}],
    [{"é": 1, "ü": 2}],
    [{"m": "aa:bb:cc:dd:ee:ff"}, {"m": "AA-BB-CC-DD-EE-FF"}, {"m": "AA:BB:CC:DD:EE:FF"}, {"m": "AA:BB:CC:DD:EE:FF"}],
    [{"a": None}, {}],
    [{f"k{i}": i for i in range(70)}] * 3,
    [{"s": f"v{i % 90}"} for i in range(400)],
    [{"s": "x" if i % 10 else f"y{i}"} for i in range(50)],
    [{"a": "line\n\"q\" é"}],
    [{"n": v} for v in [5] * 200 + [6] * 3 + [100000]],
    [{"n": v / 65536} for v in (0, 1, 2, 3)],
    [{"b": b"\x00\xff"}, {"b": b""}],
    [{"v": [0.5] * 9}, {"v": [1, "x", None, [2.5]]}],
    [],
]


@pytest.mark.parametrize("records", EDGES)
@pytest.mark.parametrize("compress", ["none", "zlib", "lz", "huffman"])
def test_edges(records, compress):
    _same(records, wire.decode(wire.encode_records(records, compress=compress)))


def test_random_records():
    rng = random.Random(5)
    make = [lambda: rng.randint(-9, 9), lambda: rng.randint(-(2**62), 2**62), rng.random, lambda: rng.choice("abc") * 3, lambda: rng.random() < 0.5, lambda: None]
    for _ in range(200):
        kinds = {f"f{i}": rng.choice(make) for i in range(rng.randint(1, 5))}
        records = [{k: f() for k, f in kinds.items() if rng.random() < 0.9} for _ in range(rng.randint(1, 60))]
        _same(records, wire.decode(wire.encode_records(records)))


def test_dictionaries_live_on_and_reset():
    e, d = wire.Encoder(), wire.Decoder()
    units = [wire.encode_records([{"s": "word"}, {"s": f"w{i}"}], e) for i in range(100)]
    assert len(units[1]) < len(units[0])
    assert [wire.decode(u, d)[1]["s"] for u in units] == [f"w{i}" for i in range(100)]
    e.reset(), d.reset()
    assert wire.encode_records([{"s": "word"}, {"s": "w0"}], e) == units[0]


def test_deltas_in_place_of_values():
    name = lambda x: bytes([wire.NEW_FIELD, 1]) + x.encode()
    again = lambda *fields: b"".join(bytes([wire.OBJECT, *x, wire.OBJECT_END]) for x in fields)
    first = bytes([wire.OBJECT]) + name("a") + bytes([wire.INT, 20]) + name("b") + bytes([wire.FIXED16, 128, 1]) + bytes([wire.OBJECT_END])
    deltas = [(wire.SAME,), (wire.UP,), (wire.DOWN,), (wire.SMALL,), (wire.LARGE - 1,), (wire.MEDIUM, 0), (wire.LARGE, 0xC8, 1)]
    got = wire.Decoder().items(first + again(*[(0, *d) for d in deltas]) + again(*[(1, *d) for d in deltas]))
    steps = [0, 1, -1, -8, 7, -64, 100]
    assert got[0] == {"a": 10, "b": 1.5}
    assert [x["a"] for x in got[1:8]] == [10 + sum(steps[: i + 1]) for i in range(7)]
    assert [x["b"] for x in got[8:]] == [1.5 + sum(steps[: i + 1]) / 65536 for i in range(7)]
    rows = wire.Decoder().items(bytes([wire.RECORDS, 2, 2]) + name("a") + name("b") + bytes([wire.INT, 20, wire.INT, 2, wire.UP, wire.DOWN]))
    assert rows[0].rows() == [{"a": 10, "b": 1}, {"a": 11, "b": 0}]
    for data in (bytes([wire.UP]), bytes([wire.OBJECT]) + name("a") + bytes([wire.UP, wire.OBJECT_END])):
        with pytest.raises(wire.FormatError):
            wire.Decoder().items(data)


def test_damage_is_seen():
    frame = wire.encode_records([{"a": i, "s": "text"} for i in range(20)])
    for i in range(len(frame)):
        broken = bytearray(frame)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            wire.decode(bytes(broken))
    for cut in (0, 5, len(frame) - 1):
        with pytest.raises(ValueError):
            wire.parse_frame(frame[:cut])


def test_streams_of_frames():
    frames = [wire.encode_records([{"a": i}]) for i in range(5)]
    blob = b"junk" + b"".join(frames)
    assert wire.split_frames(blob) == (frames, len(blob))
    found, used = wire.split_frames(blob[:-3])
    assert found == frames[:4] and used == len(blob) - len(frames[4])


def test_rice_and_varints():
    u = np.array([0, 1, 5, 200, 17, 1023], np.uint64)
    for k in range(8):
        assert wire.rice_decode(wire.rice_encode(u, k), len(u), k)[0].tolist() == u.tolist()
    for n in (0, 127, 128, 2**35, 2**64 - 1):
        assert wire.read_varint(wire.varint(n), 0)[0] == n
    with pytest.raises(ValueError):
        wire.varint(-1)


KINDS = ["auto", "mtf", "lz", "huffman", "lz_huffman", "huffman_lz", "stored", "block"]


@pytest.mark.parametrize("kind", KINDS)
def test_transforms(kind):
    rng = random.Random(3)
    data = [b"", b"a", b"ab" * 500, bytes(1000), b"\xfe\xff" * 50 + b"\xff" * 300, bytes(257) + b"x" + bytes(2), struct.pack("<200d", *(rng.random() for _ in range(200)))]
    data += [bytes(rng.choices([0, 1, 254, 255, 7], k=rng.randint(0, 900))) for _ in range(40)]
    data += [b"x" * n + b"yz" * m for n in (2, 3, 257, 258, 259, 8192) for m in (1, 137)]
    for d in data:
        packed = transforms.transform(d, kind)
        assert transforms.untransform(packed) == d
        assert transforms.rle_decode(transforms.rle_encode(d)) == d


def test_huffman_lengths_stay_within_the_limit():
    a, b, counts = 1, 1, {}
    for s in range(30):
        counts[s] = a
        a, b = b, a + b
    lengths = transforms.code_lengths(counts)
    assert max(lengths.values()) == 15 and sum(2.0**-n for n in lengths.values()) == 1.0
    codes = transforms.canonical_codes(lengths)
    texts = sorted(f"{c:0{n}b}" for c, n in codes.values())
    assert not any(y.startswith(x) for x, y in zip(texts, texts[1:], strict=False))


def test_running_window():
    a, b = transforms.LzWindow(), transforms.LzWindow()
    rng = random.Random(9)
    pieces = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(0, 3000))).encode() for _ in range(12)] + [b"", b"x", bytes(20_000)]
    packed = [a.compress(p) for p in pieces]
    assert [b.decompress(p) for p in packed] == pieces
    again = b"a sentence that comes twice, word for word"
    assert len(a.compress(again)) > len(a.compress(again))


def _log_lines():
    return "".join(f"2024-01-{i % 28 + 1:02d} 10:{i % 60:02d}:{i * 7 % 60:02d} INFO worker-{i % 9} request id={i * 37 % 9973} took {i * 13 % 500} ms status=200\n" for i in range(1500)).encode()


def test_lz_makes_texts_smaller():
    """Ratios on log lines, JSON, prose and the running window, not only round trips."""
    import pyarrow.parquet as pq

    log = _log_lines()
    packed = transforms.lz_compress(log)
    assert packed[0] == 2 and 3 * len(packed) < len(log) and transforms.lz_decompress(packed) == log
    docs = [x.encode() for x in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if x and len(x) >= 500]
    small = [transforms.lz_compress(x) for x in docs]
    assert all(transforms.lz_decompress(y) == x for x, y in zip(docs, small, strict=True))
    assert sum(y[0] == 2 for y in small) >= 0.95 * len(docs) and 1.3 * sum(map(len, small)) < sum(map(len, docs))
    for kind in ("lz", "auto", "lz_huffman"):
        assert 3 * len(transforms.transform(log, kind)) < len(log), kind
    out, back, sizes = transforms.LzWindow(), transforms.LzWindow(), 0
    for i in range(0, len(log), 700):  # short pieces find their matches in the window
        y = out.compress(log[i : i + 700])
        assert back.decompress(y) == log[i : i + 700]
        sizes += len(y)
    assert 2.5 * sizes < len(log)


@pytest.mark.parametrize("history", [0, 3, 300, 9000])
def test_lz_at_the_edges(history):
    rng = random.Random(history)
    before = bytes(rng.choice(b"abcd") for _ in range(history))
    texts = [b"", b"a", b"abcdefgh", b"ab" * 500, bytes(5000), bytes(range(256)) * 3, b"x" * 7 + b"abcd" * 68 + b"y" + b"abcd" * 69, b"q" * 273, b"q" * 277]
    texts += [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90))) * rng.randint(1, 12) for _ in range(300)]
    for x in texts:
        assert transforms.lz_decompress(transforms.lz_compress(x, before), before) == x


def test_huffman_lengths_are_least():
    rng = random.Random(4)
    for _ in range(40):
        counts = {i: rng.choice([1, 2, 3, 50, 1000, 10**6]) for i in range(rng.randint(2, 60))}
        a, b = transforms.code_lengths(counts), transforms._limited_lengths(counts, 15)
        assert sum(2.0**-x for x in a.values()) == 1 and max(a.values()) <= 15
        assert sum(counts[s] * n for s, n in a.items()) == sum(counts[s] * n for s, n in b.items())


def test_flags_and_reset():
    e, d = wire.Encoder(), wire.Decoder()
    units = [wire.encode("x", e), wire.encode("x", e)]
    e.restart()
    units += [wire.encode(v, e) for v in ("w0", "x", "w0")]
    assert [wire.parse_frame(u)[0]["flags"] for u in units] == [0, 0, 4, 0, 0]
    assert [wire.decode(u, d) for u in units] == [["x"], ["x"], ["w0"], ["x"], ["w0"]]


def test_frame_builder():
    b = wire.FrameBuilder().set_flag(wire.USES_RICE).set_flag(wire.DICT_RESET).clear_flag(wire.USES_RICE)
    frame = b.token(wire.Encoder().value(7)).raw(b"").finish()
    head, data = wire.parse_frame(frame)
    assert (head["flags"], head["symbols"]) == (wire.DICT_RESET, 1) and wire.decode(frame) == [7] and data
    b.reset()
    assert wire.parse_frame(b.finish())[0]["symbols"] == 0


def test_slots_by_place():
    s = wire.Slots(3)
    s.add_at(1, "b")
    assert s.entries() == [(1, "b")] and "b" in s and s.lookup("b") == 1
    assert [s.get_or_add(x) for x in "acb"] == [(0, True), (2, True), (1, False)]
    assert s.get_or_add("d") == (0, True) and s.entries() == [(0, "d"), (1, "b"), (2, "c")]
    s.add_at(2, "b")
    assert s.entries() == [(0, "d"), (2, "b")] and s.get(2) == "b" and s.lookup("c") is None
    with pytest.raises(wire.FormatError):
        s.add_at(3, "x")


def test_cuts_of_a_stream():
    from recordloom.streaming.frames import cuts

    assert cuts([1] * 5, [False] * 5, 2, 100) == [(0, 2, False), (2, 4, False), (4, 5, False)]
    assert cuts([5, 5, 1, 9], [False] * 4, 9, 10) == [(0, 2, False), (2, 4, False)]
    assert cuts([1] * 4, [True, False, True, True], 9, 99) == [(0, 2, True), (2, 3, True), (3, 4, True)]
    assert cuts([], [], 9, 99) == []


@pytest.mark.parametrize("v", [b"\x00", b"\x01\x00\x01" * 7, bytes([0, 1, 2, 3, 3]), b"\x04\x00", b"", bytes(100)])
def test_binaries_with_few_bits(v):
    u = wire.encode(v, wire.Encoder(packs=True))
    assert wire.decode(u) == [v] and wire.decode(wire.encode(v)) == [v]
    first = wire.parse_frame(u)[1][:1]
    assert first == (bytes([wire.BINARY]) if not v or max(v) > 3 else bytes([wire.BITS1 if max(v) <= 1 else wire.BITS2]))
    assert len(u) <= len(wire.encode(v))
