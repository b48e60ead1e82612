"""Tokens, dictionaries, column batches and frames of the packed format.

Integer and double columns are written and read with numpy; the rest costs one step for each run of equal values.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import OrderedDict
from collections.abc import Sequence

import numpy as np

from . import transforms

# Fixed values of the format.
MAGIC, VERSION = b"PKR1", 1
FIELD, STRING, MAC = 0x00, 0x40, 0x80  # references, by slot
INT, FIXED16, FIXED32, SMALL, LARGE = 0xC0, 0xC1, 0xC2, 0xC3, 0xD3
NEW_STRING, NEW_FIELD, NEW_MAC, TRUE, FALSE, NULL = 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9
ARRAY, ARRAY_END, OBJECT, OBJECT_END, DOUBLE, BINARY = 0xDA, 0xDB, 0xDC, 0xDD, 0xDE, 0xDF
RECORDS, COLUMNS, REPEAT, SAME, UP, DOWN, BATCH = 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9
BITPACK, MEDIUM, RICE, FREQUENT, STREAM, PART, BITS1, BITS2 = 0xEB, 0xEC, 0xED, 0xEE, 0xEF, 0xF0, 0xF4, 0xF5
CONSTANT, DELTA, RUNS, NULLS = 1, 2, 4, 8
SLOTS, Q16 = 64, 65536.0
_MAC = re.compile(r"[0-9A-F]{2}(:[0-9A-F]{2}){5}\Z")


#: Flags of a frame, fixed by the format: new dictionary entries, Rice codes, dictionaries start afresh. Only the last is
#: written by an Encoder: it alone tells a reader what it can't see from the items.
DICT_UPDATE, USES_RICE, DICT_RESET = 1, 2, 4


class FormatError(ValueError):
    """The bytes are not what the format says."""


def varint(n: int) -> bytes:
    if n < 0:
        raise ValueError("negative")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise FormatError("varint")
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def zigzag(v: int) -> int:
    return 2 * v if v >= 0 else -2 * v - 1


def unzigzag(u: int) -> int:
    return -(u >> 1) - 1 if u & 1 else u >> 1


class Slots:
    """A dictionary of 64 slots; a new value beyond that takes the slot used longest ago. Both sides keep the same."""

    def __init__(self, size: int = SLOTS):
        self.size, self.slot_of, self.value_in = size, OrderedDict(), {}

    def get_or_add(self, value) -> tuple[int, bool]:
        """Slot, and whether it is new."""
        if value in self.slot_of:
            self.slot_of.move_to_end(value)
            return self.slot_of[value], False
        slot = len(self.slot_of)
        if slot >= self.size:
            _, slot = self.slot_of.popitem(last=False)
        elif slot in self.value_in:  # add_at() left a gap elsewhere
            slot = next(i for i in range(self.size) if i not in self.value_in)
        self.slot_of[value] = slot
        self.value_in[slot] = value
        return slot, True

    def get(self, slot: int):
        if slot not in self.value_in:
            raise FormatError(f"slot {slot} is empty")
        value = self.value_in[slot]
        self.slot_of.move_to_end(value)
        return value

    def lookup(self, value) -> int | None:
        return self.slot_of.get(value)

    def add_at(self, slot: int, value) -> None:
        """Put a value into a slot, as the one used last; what was there, and the value's old slot, go."""
        if not 0 <= slot < self.size:
            raise FormatError(f"no slot {slot}")
        self.slot_of.pop(self.value_in.pop(slot, None), None)
        self.value_in.pop(self.slot_of.pop(value, None), None)
        self.slot_of[value], self.value_in[slot] = slot, value

    def entries(self) -> list[tuple[int, object]]:
        """Slots and their values, by slot."""
        return sorted(self.value_in.items())

    def reset(self) -> None:
        self.slot_of.clear()
        self.value_in.clear()

    def __len__(self) -> int:
        return len(self.slot_of)

    def __contains__(self, value) -> bool:
        return value in self.slot_of


# --- numpy kernels ---------------------------------------------------------------------------------------------------


def zigzags(d: np.ndarray) -> np.ndarray:
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def _svarints(d: np.ndarray, lead: int) -> bytes:
    """Each number as a token and a zigzagged varint."""
    u = zigzags(d)
    size = np.ones(len(u), np.int64)
    for i in range(1, 10):
        size += u >= np.uint64(1) << np.uint64(7 * i)
    end = np.cumsum(size + 1)
    start = end - size - 1
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    out[start] = lead
    for i in range(10):
        on = size > i
        out[start[on] + 1 + i] = (u[on] >> np.uint64(7 * i)).astype(np.uint8) & 127 | np.where(size[on] > i + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def _read_svarints(data: bytes, at: int, n: int, lead: int) -> tuple[np.ndarray, int] | None:
    """n such tokens, if that is all that stands here: each ends with its first byte below 128."""
    window = np.frombuffer(data, np.uint8, count=min(len(data) - at, 11 * n), offset=at)
    ends = np.flatnonzero(window < 128)[:n]
    if len(ends) < n:
        return None
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    if n and ((window[starts] != lead).any() or (size < 1).any() or (size > 10).any()):
        return None
    u = np.zeros(n, np.uint64)
    for i in range(int(size.max(initial=0))):
        on = size > i
        u[on] |= (window[starts[on] + 1 + i].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * i)
    d = (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)
    return d, at + (int(ends[-1]) + 1 if n else 0)


def rice_encode(u: np.ndarray, k: int) -> bytes:
    q = (u >> np.uint64(k)).astype(np.int64)
    end = np.cumsum(q + 1 + k)
    bits = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    one = end - 1 - k
    bits[one] = 1
    for j in range(k):
        bits[one + 1 + j] = (u >> np.uint64(k - 1 - j)).astype(np.uint8) & 1
    return np.packbits(bits).tobytes()


def rice_decode(data: bytes, n: int, k: int) -> tuple[np.ndarray, int]:
    """n codes, and the bytes that they take."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    ones = np.flatnonzero(bits)
    after = np.searchsorted(ones, np.arange(len(bits) + 1)).tolist()
    listed, q, at, pos = ones.tolist(), [0] * n, [0] * n, 0
    for i in range(n):
        if pos > len(bits) or after[pos] >= len(listed):
            raise FormatError("Rice codes end early")
        one = listed[after[pos]]
        q[i], at[i] = one - pos, one + 1
        pos = one + 1 + k
    if pos > len(bits):
        raise FormatError("Rice codes end early")
    u = np.array(q, np.uint64)
    where = np.array(at, np.int64)
    for j in range(k):
        u = u << np.uint64(1) | bits[where + j].astype(np.uint64)
    return u, -(-pos // 8)


def bitmap(valid: np.ndarray) -> bytes:
    return np.packbits(valid.astype(np.uint8), bitorder="little").tobytes()


def _zero_runs(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    zero = np.concatenate([[False], d == 0, [False]])
    edge = np.flatnonzero(zero[1:] != zero[:-1])
    return edge[0::2], edge[1::2] - edge[0::2]


# --- encoder ---------------------------------------------------------------------------------------------------------


def is_viable(v: np.ndarray) -> bool:
    """Whether deltas on the grid of 1/65536 give every double back exactly."""
    if not len(v) or not np.isfinite(v).all() or (np.signbit(v) & (v == 0)).any():
        return False
    grid = np.rint((v - v[0]) * Q16)
    return bool((np.abs(grid) < 2.0**52).all() and (v[0] + grid / Q16 == v).all())


class Encoder:
    """Keeps its dictionaries from batch to batch until reset()."""

    def __init__(self, frequent: bool = True, packs: bool = False):
        """packs: whether binaries of zeros and ones, or of values up to 3, are written with 1 or 2 bits a byte."""
        self.fields, self.strings, self.macs, self.frequent, self.packs = Slots(), Slots(), Slots(), frequent, packs
        self.symbols = self.flags = 0

    def reset(self) -> None:
        """Start afresh, as the reader has to be told by other means."""
        for s in (self.fields, self.strings, self.macs):
            s.reset()

    def restart(self) -> None:
        """Start afresh. The next frame says so, and its reader does the same."""
        self.reset()
        self.flags |= DICT_RESET

    def field(self, name: str) -> bytes:
        self.symbols += 1
        slot, new = self.fields.get_or_add(name)
        raw = name.encode()
        return bytes([NEW_FIELD]) + varint(len(raw)) + raw if new else bytes([FIELD + slot])

    def value(self, v) -> bytes:
        self.symbols += 1
        if v is None:
            return bytes([NULL])
        if v is True or v is False:
            return bytes([TRUE if v else FALSE])
        if isinstance(v, int):
            return bytes([INT]) + varint(zigzag(v))
        if isinstance(v, float):
            return bytes([DOUBLE]) + struct.pack("<d", v)
        if isinstance(v, str):
            if len(v) == 17 and _MAC.match(v):
                slot, new = self.macs.get_or_add(v)
                return bytes([NEW_MAC]) + bytes.fromhex(v.replace(":", "")) if new else bytes([MAC + slot])
            slot, new = self.strings.get_or_add(v)
            raw = v.encode()
            return bytes([NEW_STRING]) + varint(len(raw)) + raw if new else bytes([STRING + slot])
        if isinstance(v, (bytes, bytearray)):
            if self.packs and v and max(v) <= 3:
                return packed_binary(bytes(v))
            return bytes([BINARY]) + varint(len(v)) + bytes(v)
        if isinstance(v, dict):
            self.symbols += 1
            return bytes([OBJECT]) + b"".join(self.field(str(k)) + self.value(x) for k, x in v.items()) + bytes([OBJECT_END])
        if isinstance(v, (list, tuple)):
            self.symbols += 1
            if len(v) > 4 and all(type(x) is float for x in v):
                self.symbols += len(v)
                body = np.zeros((len(v), 9), np.uint8)
                body[:, 0] = DOUBLE
                body[:, 1:] = np.array(v, "<f8").view(np.uint8).reshape(-1, 8)
                return bytes([ARRAY]) + varint(len(v)) + body.tobytes() + bytes([ARRAY_END])
            return bytes([ARRAY]) + varint(len(v)) + b"".join(map(self.value, v)) + bytes([ARRAY_END])
        return self.value(str(v))

    def batch(self, columns: Sequence[tuple[str, object, np.ndarray | None]], n: int) -> bytes:
        """columns: name, values (an integer or double array, or a list), and which are valid (None: all)."""
        self.symbols += 1
        head, bodies = [bytes([BATCH]), varint(n), varint(len(columns))], []
        plans = []
        for name, values, valid in columns:
            if valid is not None and valid.all():
                valid = None
            flags = self.plan(values, valid, n)
            head += [self.field(name), bytes([flags])]
            self.symbols += 1
            plans.append((values, valid, flags))
        for values, valid, flags in plans:
            if flags & NULLS:
                bodies.append(bitmap(valid))
            bodies.append(self.body(values, valid, flags, n))
        return b"".join(head + bodies)

    def plan(self, values, valid: np.ndarray | None, n: int) -> int:
        if n == 0 or valid is not None and not valid.any():
            return CONSTANT
        nulls = NULLS if valid is not None else 0
        if not nulls and all_equal(values):
            return CONSTANT
        if isinstance(values, np.ndarray):
            filled = fill_forward(values, valid)
            if filled.dtype == np.int64 or is_viable(filled):
                return DELTA | nulls
        return RUNS | nulls

    def body(self, values, valid: np.ndarray | None, flags: int, n: int) -> bytes:
        if flags & CONSTANT:
            empty = n == 0 or valid is not None and not valid.any()
            return self.value(None if empty else values[0].item() if isinstance(values, np.ndarray) else values[0])
        if flags & DELTA:
            v = fill_forward(values, valid)
            first = self.value(v[0].item())
            with np.errstate(over="ignore"):
                d = np.diff(v) if v.dtype == np.int64 else np.diff(np.rint((v - v[0]) * Q16)).astype(np.int64)
            return first + self.deltas(d)
        if isinstance(values, np.ndarray):
            return self.doubles(fill_forward(values, valid))
        if valid is not None:
            first = values[int(np.flatnonzero(valid)[0])]
            values = [x if ok else first for x, ok in zip(values, valid.tolist(), strict=True)]
        return self.runs(values)

    def deltas(self, d: np.ndarray) -> bytes:
        n = len(d)
        if not n:
            return b""
        u = zigzags(d)
        starts, sizes = _zero_runs(d)
        long = sizes > 3
        if ((d >= -8) & (d <= 7)).all():
            rle = n - int(sizes[long].sum()) + int((2 + (sizes[long] > 127)).sum())
            if not rle < 0.8 * (n / 2 + 5):
                self.symbols += 1
                half = np.zeros(n + n % 2, np.uint8)
                half[:n] = d + 8
                return bytes([BITPACK]) + varint(n) + (half[0::2] << 4 | half[1::2]).tobytes()
        top = max(int(d.max()), -int(d.min()))
        if n >= 10 and top < 1024:
            k = max(0, min(7, top.bit_length() - 2)) if top else 2
            size = -(-int(((u >> np.uint64(k)) + np.uint64(1 + k)).sum()) // 8) + 1
            if size < 1.5 * n:
                self.symbols += 1
                return bytes([RICE]) + varint(n) + bytes([k]) + rice_encode(u, k)
        if ((d >= -64) & (d <= 63)).sum() * 4 < n:  # nearly all are large: one kind of token
            self.symbols += n
            return _svarints(d, LARGE)
        out, at = [], 0
        for s, z in [*zip(starts[long].tolist(), sizes[long].tolist(), strict=True), (n, 0)]:
            out += map(_delta_token, d[at:s].tolist())
            self.symbols += s - at + (z > 0)
            if z:
                out.append(bytes([REPEAT]) + varint(z))
            at = s + z
        return b"".join(out)

    def doubles(self, v: np.ndarray) -> bytes:
        """Values with runs; runs are of equal bit patterns."""
        raw = np.ascontiguousarray(v, "<f8").view(np.int64)
        starts = np.flatnonzero(np.append(True, raw[1:] != raw[:-1]))
        sizes = np.diff(np.append(starts, len(v)))
        self.symbols += len(starts) + int((sizes > 1).sum())
        body = np.zeros((len(starts), 9), np.uint8)
        body[:, 0] = DOUBLE
        body[:, 1:] = raw[starts].view(np.uint8).reshape(-1, 8)
        if (sizes == 1).all():
            return body.tobytes()
        return b"".join(x.tobytes() + (bytes([REPEAT]) + varint(z - 1) if z > 1 else b"") for x, z in zip(body, sizes.tolist(), strict=True))

    def runs(self, values: list) -> bytes:
        n = len(values)
        if self.frequent and n >= 8 and all(isinstance(x, str) for x in values):
            counts: dict[str, int] = {}
            for x in values:
                counts[x] = counts.get(x, 0) + 1
            best = max(counts, key=counts.get)
            if counts[best] * 10 >= n * 6:
                others = [x for x in values if x != best]
                self.symbols += 1
                return bytes([FREQUENT]) + varint(n) + self.value(best) + bitmap(np.array([x != best for x in values])) + b"".join(map(self.value, others))
        out, i = [], 0
        while i < n:
            j = i + 1
            while j < n and same(values[i], values[j]):
                j += 1
            out.append(self.value(values[i]))
            if j - i > 1:
                self.symbols += 1
                out.append(bytes([REPEAT]) + varint(j - i - 1))
            i = j
        return b"".join(out)

    def frame(self, items: bytes) -> bytes:
        """A frame around what was encoded since the last one; after restart() it says so."""
        made = FrameBuilder(self.symbols, self.flags).raw(items).finish()
        self.symbols = self.flags = 0
        return made


def packed_binary(v: bytes) -> bytes:
    """A binary whose bytes are at most 3 with 1 or 2 bits for each, the lowest first."""
    each = 1 if max(v) <= 1 else 2
    bits = np.unpackbits(np.frombuffer(v, np.uint8).reshape(-1, 1), axis=1, count=each, bitorder="little")
    return bytes([BITS1 if each == 1 else BITS2]) + varint(len(v)) + np.packbits(bits.ravel(), bitorder="little").tobytes()


class FrameBuilder:
    """Collects a frame's items; finish() puts header and checksum around them."""

    def __init__(self, symbols: int = 0, flags: int = 0):
        self.symbols, self.flags, self.parts = symbols, flags, []

    def token(self, item: bytes) -> FrameBuilder:
        """An item that counts as a symbol."""
        self.symbols += 1
        return self.raw(item)

    def raw(self, data: bytes) -> FrameBuilder:
        self.parts.append(data)
        return self

    def set_flag(self, flag: int) -> FrameBuilder:
        self.flags |= flag
        return self

    def clear_flag(self, flag: int) -> FrameBuilder:
        self.flags &= ~flag
        return self

    def reset(self) -> None:
        self.symbols, self.flags, self.parts = 0, 0, []

    def finish(self) -> bytes:
        body = MAGIC + bytes([VERSION, self.flags]) + varint(self.symbols) + b"".join(self.parts)
        return body + zlib.crc32(body).to_bytes(4, "little")


def _delta_token(d: int) -> bytes:
    if d == 0:
        return bytes([SAME])
    if d == 1:
        return bytes([UP])
    if d == -1:
        return bytes([DOWN])
    if -8 <= d <= 7:
        return bytes([SMALL + d + 8])
    if -64 <= d <= 63:
        return bytes([MEDIUM, d + 64])
    return bytes([LARGE]) + varint(zigzag(d))


def same(a, b) -> bool:
    """Equal and of one type, all the way down."""
    if type(a) is not type(b):
        return False
    if isinstance(a, float):
        return struct.pack("<d", a) == struct.pack("<d", b)
    if isinstance(a, dict):
        return list(a) == list(b) and all(same(a[k], b[k]) for k in a)
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def all_equal(values) -> bool:
    if isinstance(values, np.ndarray):
        raw = values.view(np.int64)
        return bool((raw == raw[0]).all())
    return all(same(values[0], x) for x in values)


def fill_forward(v: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
    if valid is None:
        return v
    at = np.maximum.accumulate(np.where(valid, np.arange(len(v)), -1))
    return v[np.where(at < 0, np.flatnonzero(valid)[0], at)]


# --- decoder ---------------------------------------------------------------------------------------------------------


class Batch:
    """A decoded batch: names, and by column the values (an array or a list) with None where a row has none."""

    def __init__(self, n: int, names: list[str], columns: list):
        self.n, self.names, self.columns = n, names, columns

    def rows(self) -> list[dict]:
        """Records without their nulls."""
        return [{k: v for k, v in zip(self.names, r, strict=True) if v is not None} for r in zip(*map(as_list, self.columns), strict=True)] if self.names else [{} for _ in range(self.n)]


def as_list(column) -> list:
    values, valid = column
    values = values.tolist() if isinstance(values, np.ndarray) else values
    return values if valid is None else [v if ok else None for v, ok in zip(values, valid.tolist(), strict=True)]


class Decoder:
    """The other side of an Encoder: reads every item of the grammar, also those that are no longer written."""

    def __init__(self):
        self.fields, self.strings, self.macs = Slots(), Slots(), Slots()
        self.numbers: dict[int, int | float] = {}  # slot of a field: its last number
        self.slot = self.current = None  # slot of the field read last, and of that whose value is read

    def reset(self) -> None:
        for s in (self.fields, self.strings, self.macs):
            s.reset()
        self.numbers.clear()

    def items(self, data: bytes) -> list:
        """All values and batches of a frame's data. A stream of batches is one list of batches."""
        self.data, self.at, self.current, out = data, 0, None, []
        while self.at < len(data):
            out.append(self.item())
        return out

    def item(self):
        return self.batch() if self.data[self.at] in (BATCH, PART, RECORDS, COLUMNS) else self.value()

    def _take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FormatError("data end early")
        self.at += n
        return self.data[self.at - n : self.at]

    def _varint(self) -> int:
        n, self.at = read_varint(self.data, self.at)
        return n

    def field(self) -> str:
        t = self._take(1)[0]
        if t == NEW_FIELD:
            name = self._take(self._varint()).decode()
            self.slot, _ = self.fields.get_or_add(name)
            return name
        if t < STRING:
            self.slot = t
            return self.fields.get(t)
        raise FormatError(f"{t:#x} is no field")

    def _of(self, slot: int | None, read):
        """What read() gives as a value of the field in this slot."""
        before, self.current = self.current, slot
        out = read()
        self.current = before
        return out

    def _number(self, x: int | float) -> int | float:
        """x, which the next delta of the field is added to."""
        if self.current is not None:
            self.numbers[self.current] = x
        return x

    def _moved(self, d: int) -> int | float:
        """The field's last number and a delta, which counts in 1/65536 if that number is a float."""
        if self.current not in self.numbers:
            raise FormatError("delta without a number before it")
        last = self.numbers[self.current]
        return self._number(last + (d / Q16 if isinstance(last, float) else d))

    def value(self):
        t = self._take(1)[0]
        if t == INT:
            return self._number(unzigzag(self._varint()))
        if t == DOUBLE:
            return self._number(struct.unpack("<d", self._take(8))[0])
        if t in (SAME, UP, DOWN):
            return self._moved({SAME: 0, UP: 1, DOWN: -1}[t])
        if SMALL <= t < LARGE:
            return self._moved(t - SMALL - 8)
        if t == MEDIUM:
            return self._moved(self._take(1)[0] - 64)
        if t == LARGE:
            return self._moved(unzigzag(self._varint()))
        if t == NEW_STRING:
            s = self._take(self._varint()).decode()
            self.strings.get_or_add(s)
            return s
        if STRING <= t < MAC:
            return self.strings.get(t - STRING)
        if t == NEW_MAC:
            s = self._take(6).hex(":").upper()
            self.macs.get_or_add(s)
            return s
        if MAC <= t < INT:
            return self.macs.get(t - MAC)
        if t in (TRUE, FALSE, NULL):
            return {TRUE: True, FALSE: False, NULL: None}[t]
        if t == ARRAY:
            n = self._varint()
            stop = self.at + 9 * n
            if n > 4 and stop < len(self.data) and self.data[stop] == ARRAY_END and self.data[self.at : stop : 9] == bytes([DOUBLE]) * n:
                raw = np.frombuffer(self._take(9 * n), np.uint8).reshape(-1, 9)[:, 1:]
                self.at += 1
                out = np.ascontiguousarray(raw).view("<f8").ravel().tolist()
                self._number(out[-1])
                return out
            out = []
            while self.data[self.at] != ARRAY_END and len(out) < n:
                out.append(self.value())
            if self._take(1)[0] != ARRAY_END:
                raise FormatError("array without an end")
            return out
        if t == STREAM:
            out = []
            while self.data[self.at] != ARRAY_END:
                out.append(self.item())
            self.at += 1
            return out
        if t == OBJECT:
            out = {}
            while self.data[self.at] != OBJECT_END:
                name = self.field()
                out[name] = self._of(self.slot, self.value)
            self.at += 1
            return out
        if t == BINARY:
            return self._take(self._varint())
        if t == FIXED16:
            return self._number(int.from_bytes(self._take(2), "little", signed=True) / 256)
        if t == FIXED32:
            return self._number(int.from_bytes(self._take(4), "little", signed=True) / Q16)
        if t in (BITS1, BITS2):
            n, each = self._varint(), 1 if t == BITS1 else 2
            bits = np.unpackbits(np.frombuffer(self._take(-(-n * each // 8)), np.uint8), bitorder="little")[: n * each].reshape(-1, each)
            return (bits * (1 << np.arange(each))).sum(axis=1).astype(np.uint8).tobytes()
        raise FormatError(f"{t:#x} starts no value")

    def batch(self) -> Batch:
        kind = self._take(1)[0]
        n, width = self._varint(), self._varint()
        if kind == RECORDS:
            fields = [(self.field(), self.slot) for _ in range(width)]
            names = [name for name, _ in fields]
            rows = [[self._of(slot, self.value) for _, slot in fields] for _ in range(n)]
            return Batch(n, names, [([r[i] for r in rows], None) for i in range(width)])
        if kind == COLUMNS:
            names = [self.field() for _ in range(width)]
            return Batch(n, names, [(self._runs(n), None) for _ in names])
        heads = [(self.field(), self._take(1)[0]) for _ in range(width)]
        return Batch(n, [h[0] for h in heads], [self._column(n, flags) for _, flags in heads])

    def _column(self, n: int, flags: int):
        valid = None
        if flags & NULLS:
            valid = np.unpackbits(np.frombuffer(self._take(-(-n // 8)), np.uint8), bitorder="little")[:n].astype(bool)
        if flags & CONSTANT:
            v = self.value()
            return [v] * n, valid
        if self.at < len(self.data) and self.data[self.at] == FREQUENT:
            self.at += 1
            m, best = self._varint(), self.value()
            other = np.unpackbits(np.frombuffer(self._take(-(-m // 8)), np.uint8), bitorder="little")[:m].tolist()
            return [self.value() if x else best for x in other], valid
        if flags & DELTA:
            first = self.value()
            d = self._deltas(n - 1)
            if isinstance(first, float):
                return first + np.concatenate([[0], np.cumsum(d)]) / Q16, valid
            with np.errstate(over="ignore"):
                return np.cumsum(np.concatenate([np.array([first], np.int64), d])), valid
        return self._runs(n), valid

    def _deltas(self, n: int) -> np.ndarray:
        if n <= 0:
            return np.zeros(0, np.int64)
        t = self.data[self.at]
        if t == BITPACK:
            self.at += 1
            m = self._varint()
            raw = np.frombuffer(self._take(-(-m // 2)), np.uint8)
            return np.stack([raw >> 4, raw & 15], axis=1).ravel()[:m].astype(np.int64) - 8
        if t == RICE:
            self.at += 1
            m = self._varint()
            k = self._take(1)[0]
            u, used = rice_decode(self.data[self.at : self.at + -(-m * (2048 + k) // 8)], m, k)
            self.at += used
            return (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)
        if t == LARGE and (read := _read_svarints(self.data, self.at, n, LARGE)) is not None:
            self.at = read[1]
            return read[0]
        out: list[int] = []
        while len(out) < n:
            t = self._take(1)[0]
            if t == REPEAT:
                out += [0] * self._varint()
            elif t in (SAME, UP, DOWN):
                out.append({SAME: 0, UP: 1, DOWN: -1}[t])
            elif SMALL <= t < LARGE:
                out.append(t - SMALL - 8)
            elif t == MEDIUM:
                out.append(self._take(1)[0] - 64)
            elif t == LARGE:
                out.append(unzigzag(self._varint()))
            else:
                raise FormatError(f"{t:#x} is no delta")
        if len(out) != n:
            raise FormatError("too many deltas")
        return np.array(out, np.int64)

    def _runs(self, n: int):
        stop = self.at + 9 * n
        if n and stop <= len(self.data) and self.data[self.at : stop : 9] == bytes([DOUBLE]) * n:
            raw = np.frombuffer(self._take(9 * n), np.uint8).reshape(-1, 9)[:, 1:]
            return np.ascontiguousarray(raw).view("<f8").ravel()
        out: list = []
        while len(out) < n:
            v = self.value()
            out.append(v)
            if len(out) < n and self.at < len(self.data) and self.data[self.at] == REPEAT:
                self.at += 1
                out += [v] * self._varint()
        if len(out) != n:
            raise FormatError("too long a run")
        return out


def parse_frame(data: bytes, verify: bool = True) -> tuple[dict, bytes]:
    """Header fields and data of a frame that ends with its bytes."""
    if len(data) < 11 or data[:4] != MAGIC:
        raise FormatError("no frame")
    if data[4] != VERSION:
        raise FormatError(f"version {data[4]}")
    crc = int.from_bytes(data[-4:], "little")
    if verify and zlib.crc32(data[:-4]) != crc:
        raise FormatError("checksum")
    symbols, at = read_varint(data, 6)
    return {"version": data[4], "flags": data[5], "symbols": symbols, "crc": crc}, data[at:-4]


def split_frames(blob: bytes) -> tuple[list[bytes], int]:
    """Whole frames of a concatenation, and the bytes that they and what was skipped between them take.

    A frame says nothing about its length: it ends before the next magic, or at the end, where its checksum fits. An
    incomplete tail is left, so that a reader can go on with more bytes.
    """
    out, at, done = [], blob.find(MAGIC), 0
    while at >= 0:
        end, found = blob.find(MAGIC, at + 4), -1
        crc, seen = 0, at
        while found < 0:
            stop = end if end >= 0 else len(blob)
            if stop - at >= 11:
                crc = zlib.crc32(blob[seen : stop - 4], crc)  # continued, so bytes are looked at once
                seen = stop - 4
                if crc == int.from_bytes(blob[stop - 4 : stop], "little"):
                    found = stop
                    break
            if end < 0:
                break
            end = blob.find(MAGIC, end + 4)
        if found >= 0:
            out.append(blob[at:found])
            done = found
            at = blob.find(MAGIC, found)
        else:
            at = blob.find(MAGIC, at + 4)
    return out, done


def pack_unit(frame: bytes, compress: str = "zlib") -> bytes:
    """The frame, or a transform of it where that is shorter. Transforms other than zlib stand behind FE."""
    if compress == "none" or len(frame) <= 20:
        return frame
    small = b"\xff" + zlib.compress(frame, 1) if compress == "zlib" else b"\xfe" + transforms.transform(frame, compress)
    return small if len(small) < len(frame) else frame


def unpack_unit(unit: bytes) -> bytes:
    if unit[:4] == MAGIC:
        return unit
    try:
        return transforms.untransform(unit[1:] if unit[:1] == b"\xfe" else unit)
    except (zlib.error, IndexError) as e:
        raise FormatError(f"damaged unit: {e}") from e


def encode(value, encoder: Encoder | None = None, compress: str = "none") -> bytes:
    """One value as a unit."""
    e = encoder or Encoder()
    return pack_unit(e.frame(e.value(value)), compress)


def decode(unit: bytes, decoder: Decoder | None = None, verify: bool = True) -> list:
    """Values of a unit; batches become their records."""
    out: list = []
    decoder = decoder or Decoder()
    header, data = parse_frame(unpack_unit(unit), verify)
    if header["flags"] & DICT_RESET:
        decoder.reset()
    for x in decoder.items(data):
        parts = x if isinstance(x, list) and x and all(isinstance(y, Batch) for y in x) else [x]
        for p in parts:
            out += p.rows() if isinstance(p, Batch) else [p]
    return out


def encode_records(records: list[dict], encoder: Encoder | None = None, compress: str = "none") -> bytes:
    """Records as one batch: the union of their keys in order of appearance, types kept apart."""
    e = encoder or Encoder()
    names = list(dict.fromkeys(k for r in records for k in r))
    columns = []
    for name in names:
        values = [r.get(name) for r in records]
        valid = np.array([v is not None for v in values])
        some = [v for v in values if v is not None]
        kinds = {type(v) for v in some}
        if kinds == {int} and all(-(2**63) <= v < 2**63 for v in some):
            values = np.array([v if v is not None else 0 for v in values], np.int64)
        elif kinds == {float}:
            values = np.array([v if v is not None else math.nan for v in values], np.float64)
        columns.append((name, values, valid))
    return pack_unit(e.frame(e.batch(columns, len(records))), compress)
