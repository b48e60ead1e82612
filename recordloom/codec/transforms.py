"""Byte transforms, binary to binary. Loops run over matches, runs or symbols, and over numpy arrays, not over bytes."""

from __future__ import annotations

import heapq
import zlib

import numpy as np


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal bytes."""
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(a)))


def mtf_encode(data: bytes) -> bytes:
    """Place of each byte in a list in which the byte used last comes first. A run costs one step."""
    a = np.frombuffer(data, np.uint8)
    out = np.zeros(len(a), np.uint8)
    recent = bytearray(range(256))
    starts, _ = _runs(a)
    for i, b in zip(starts.tolist(), a[starts].tolist(), strict=True):
        at = recent.index(b)
        out[i] = at
        if at:
            del recent[at]
            recent.insert(0, b)
    return out.tobytes()


def mtf_decode(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    out = np.zeros(len(a), np.uint8)
    if not len(a):
        return b""
    recent = bytearray(range(256))
    at = np.flatnonzero(np.append(True, a[1:] != 0))
    ends = np.append(at[1:], len(a))
    for i, e, p in zip(at.tolist(), ends.tolist(), a[at].tolist(), strict=True):
        b = recent[p]
        if p:
            del recent[p]
            recent.insert(0, b)
        out[i:e] = b
    return out.tobytes()


def rle_encode(data: bytes) -> bytes:
    """FE byte n-3 for runs of 3 to 258; FE and FF themselves as FF 00 byte."""
    a = np.frombuffer(data, np.uint8)
    starts, sizes = _runs(a)
    out = bytearray()
    plain = 0  # where bytes not yet written begin

    def literals(to: int) -> None:
        for b in data[plain:to]:
            out.extend((0xFF, 0, b) if b >= 0xFE else (b,))

    for s, n in zip(starts[sizes >= 3].tolist(), sizes[sizes >= 3].tolist(), strict=True):
        literals(s)
        at, left = s, n
        while left >= 3:
            take = min(left, 258)
            out.extend((0xFE, data[at], take - 3))
            at, left = at + take, left - take
        plain = at
    literals(len(data))
    return bytes(out)


def rle_decode(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data):
        marks = [x for x in (data.find(b"\xfe", i), data.find(b"\xff", i)) if x >= 0]
        at = min(marks, default=len(data))
        out.append(data[i:at])
        if at < len(data):
            if data[at] == 0xFE:
                out.append(data[at + 1 : at + 2] * (data[at + 2] + 3))
            elif data[at + 1] == 0:
                out.append(data[at + 2 : at + 3])
            else:
                out.append(data[at + 2 : at + 3] * data[at + 1])
        i = at + 3
    return b"".join(out)


def zero_rle_encode(data: bytes) -> bytes:
    """FF n-2 for 2 to 255 zeros; FE and FF themselves as FE byte; a single zero stays."""
    a = np.frombuffer(data, np.uint8)
    starts, sizes = _runs(a)
    keep = (a[starts] == 0) & (sizes >= 2) if len(a) else np.zeros(0, bool)
    out, plain = bytearray(), 0

    def literals(to: int) -> None:
        out.extend(data[plain:to].replace(b"\xfe", b"\xfe\xfe").replace(b"\xff", b"\xfe\xff"))

    for s, n in zip(starts[keep].tolist(), sizes[keep].tolist(), strict=True):
        literals(s)
        left = n
        while left >= 2:
            take = min(left, 255)
            out.extend((0xFF, take - 2))
            left -= take
        plain = s + n - left
    literals(len(data))
    return bytes(out)


def zero_rle_decode(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data):
        marks = [x for x in (data.find(b"\xfe", i), data.find(b"\xff", i)) if x >= 0]
        at = min(marks, default=len(data))
        out.append(data[i:at])
        if at < len(data):
            out.append(bytes(data[at + 1] + 2) if data[at] == 0xFF else data[at + 1 : at + 2])
        i = at + 2
    return b"".join(out)


def block_sort(data: bytes, block: int = 256) -> tuple[bytes, bytes]:
    """Each block's bytes in stable order, and where they came from (block <= 256)."""
    a = np.frombuffer(data, np.uint8)
    whole = len(a) // block * block
    body = a[:whole].reshape(-1, block)
    order = np.argsort(body, axis=1, kind="stable")
    tail = np.argsort(a[whole:], kind="stable")
    places = np.concatenate([order.ravel(), tail]).astype(np.uint8)
    return np.concatenate([np.take_along_axis(body, order, axis=1).ravel(), a[whole:][tail]]).tobytes(), places.tobytes()


def block_unsort(data: bytes, places: bytes, block: int = 256) -> bytes:
    a, p = np.frombuffer(data, np.uint8), np.frombuffer(places, np.uint8).astype(np.int64)
    out = np.empty_like(a)
    out[p + np.arange(len(a)) // block * block] = a
    return out.tobytes()


def _stored(data: bytes) -> bytes:
    return b"\x00" + len(data).to_bytes(4, "little") + data


#: Farthest and longest match, the gate's sample and share of distinct bytes from which data are stored.
LZ_FAR, LZ_LONG, LZ_SAMPLE, LZ_DISTINCT = 8191, 273, 1024, 0.80


#: Bytes that are compared for every place at once, longer ones only where a match is taken.
_LZ_SEEN = 32


def _agree(words: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How many of the next bytes, up to _LZ_SEEN, are the same at c and p; words: eight bytes from each place."""
    out = np.zeros(len(c), np.int64)
    live = np.arange(len(c))
    for step in range(0, _LZ_SEEN, 8):
        x = words[c[live] + step] ^ words[p[live] + step]
        same = np.bitwise_count((x & -x) - np.uint64(1)).astype(np.int64) >> 3  # bytes below the lowest bit that differs
        out[live] += same
        live = live[same == 8]
        if not len(live):
            break
    return out


def _lz_matches(whole: bytes, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places from base on, lengths and distances of matches, taken greedily from the left.

    A place is compared with the last two before it that begin with the same four bytes, all places at once; a loop
    runs over the matches that are taken.
    """
    n = len(whole)
    padded = whole + bytes(_LZ_SEEN + 8)
    words, heads = np.ndarray(n + _LZ_SEEN, "<u8", padded, strides=(1,)).copy(), np.ndarray(n - 3, "<u4", padded, strides=(1,))
    order = heads.astype(np.uint64) << np.uint64(32) | np.arange(n - 3, dtype=np.uint64)
    order.sort()
    place, head = (order & np.uint64(0xFFFFFFFF)).astype(np.int64), order >> np.uint64(32)
    before = np.full(n - 3, -1, np.int64)
    same = head[1:] == head[:-1]
    before[place[1:][same]] = place[:-1][same]
    c = before[base:]
    p = np.flatnonzero((c >= 0) & (np.arange(base, n - 3) - c <= LZ_FAR))
    c, p = c[p], p + base
    size = _agree(words, c, p)
    other = before[c]
    more = np.flatnonzero((other >= 0) & (p - other <= LZ_FAR) & (size < _LZ_SEEN))
    second = _agree(words, other[more], p[more])
    better = second > size[more]
    size[more[better]], c[more[better]] = second[better], other[more[better]]
    size = np.minimum(size, n - p)
    marks = np.zeros(n - base + 1, np.int64)
    marks[p - base + 1] = 1
    following = np.cumsum(marks)  # how many places with a match lie before each
    onward = following[p + size - base]
    onward[size == _LZ_SEEN] = -1
    steps, at, i, last = onward.tolist(), [], 0, len(p)
    while i < last:
        at.append(i)
        to = steps[i]
        if to < 0:  # longer than what was compared
            k, x, y, step = _LZ_SEEN, int(p[i]), int(c[i]), _LZ_SEEN
            most = min(LZ_LONG, n - x)
            while k < most and whole[y + k : y + min(k + step, most)] == whole[x + k : x + min(k + step, most)]:
                k = min(k + step, most)
                step *= 2
            while k < most and whole[y + k] == whole[x + k]:
                k += 1
            size[i] = k
            to = int(following[x + k - base])
        i = to
    return p[at], size[at], (p - c)[at]


def _lz_written(whole: bytes, base: int, p: np.ndarray, size: np.ndarray, far: np.ndarray) -> bytes:
    """Control byte, literals and match of each match; what is left goes as literals alone."""
    a, n = np.frombuffer(whole, np.uint8), len(whole)
    tail = n > (p[-1] + size[-1] if len(p) else base)
    start = np.concatenate([[base], p + size])[: len(p) + tail]
    lit = np.concatenate([p, [n]])[: len(p) + tail] - start
    match = np.concatenate([size - 3, [0]])[: len(p) + tail]
    more_lit, more_match = (np.where(x >= 15, (x - 15) // 255 + 1, 0) for x in (lit, match))
    ends = np.full(len(lit), 2)
    ends[len(p) :] = 0
    each = 1 + more_lit + lit + more_match + ends
    at = np.cumsum(each) - each
    out = np.full(int(each.sum()), 255, np.uint8)
    out[at] = np.minimum(lit, 15) << 4 | np.minimum(match, 15)
    long = more_lit > 0
    out[(at + more_lit)[long]] = ((lit - 15) % 255)[long]
    inside = np.arange(int(lit.sum())) - np.repeat(np.cumsum(lit) - lit, lit)
    out[np.repeat(at + 1 + more_lit, lit) + inside] = a[np.repeat(start, lit) + inside]
    behind = at + 1 + more_lit + lit + more_match
    long = more_match > 0
    out[(behind - 1)[long]] = ((match - 15) % 255)[long]
    out[behind[: len(p)]], out[behind[: len(p)] + 1] = far & 255, far >> 8
    return out.tobytes()


def lz_compress(data: bytes, history: bytes = b"") -> bytes:
    """02 length tokens, or 00 length data where that is no longer.

    history: bytes that the reader has already, to which matches may reach back.
    """
    size = len(data)
    if size < 8 or len(set(data[:LZ_SAMPLE])) / min(size, LZ_SAMPLE) > LZ_DISTINCT:
        return _stored(data)
    whole = history + data
    packed = b"\x02" + size.to_bytes(4, "little") + _lz_written(whole, len(history), *_lz_matches(whole, len(history)))
    return packed if len(packed) < size + 5 else _stored(data)


def lz_decompress(data: bytes, history: bytes = b"") -> bytes:
    size = int.from_bytes(data[1:5], "little")
    if data[0] == 0:
        return data[5 : 5 + size]
    if data[0] != 2:
        raise ValueError("no LZ data")
    out, i, end = bytearray(history), 5, len(data)
    size += len(history)

    def more(n: int) -> int:
        nonlocal i
        if n == 15:
            while True:
                x = data[i]
                i += 1
                n += x
                if x < 255:
                    break
        return n

    while i < end and len(out) < size:
        ctrl = data[i]
        i += 1
        lit = more(ctrl >> 4)
        out += data[i : i + lit]
        i += lit
        if i >= end or len(out) >= size:
            break
        match = more(ctrl & 15) + 3
        off = data[i] | data[i + 1] << 8
        i += 2
        if not 0 < off <= len(out):
            raise ValueError("match outside of the window")
        while match > 0:
            take = min(match, off)
            out += out[len(out) - off : len(out) - off + take]
            match -= take
    if len(out) != size:
        raise ValueError("LZ data end early")
    return bytes(out[len(history) :])


class LzWindow:
    """LZ over a stream of chunks: each may match the bytes before it. A small, picklable state for keyed streams."""

    def __init__(self):
        self.window = b""

    def _seen(self, data: bytes) -> None:
        self.window = (self.window + data)[-LZ_FAR:]

    def compress(self, data: bytes) -> bytes:
        out = lz_compress(data, self.window)
        self._seen(data)
        return out

    def decompress(self, packed: bytes) -> bytes:
        data = lz_decompress(packed, self.window)
        self._seen(data)
        return data


def code_lengths(counts: dict[int, int], most: int = 15) -> dict[int, int]:
    """Lengths of an optimal prefix code with codes of at most so many bits."""
    if len(counts) == 1:
        return {next(iter(counts)): 1}
    # Two rarest first; above[i] is the node that i went into.
    heap = [(n, i) for i, (n, _) in enumerate(sorted((n, s) for s, n in counts.items()))]
    symbols = [s for _, s in sorted((n, s) for s, n in counts.items())]
    above, free = {}, len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        above[a[1]] = above[b[1]] = free
        heapq.heappush(heap, (a[0] + b[0], free))
        free += 1
    depth = {free - 1: 0}
    for i in range(free - 2, -1, -1):
        depth[i] = depth[above[i]] + 1
    out = {s: depth[i] for i, s in enumerate(symbols)}
    return out if max(out.values()) <= most else _limited_lengths(counts, most)


def _limited_lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """The same where the limit binds (package-merge)."""
    leaves = sorted((n, (s,)) for s, n in counts.items())
    level = leaves
    for _ in range(most - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = list(heapq.merge(leaves, pairs, key=lambda x: x[0]))
    out = dict.fromkeys(counts, 0)
    for _, symbols in level[: 2 * len(counts) - 2]:
        for s in symbols:
            out[s] += 1
    return out


def canonical_codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Code and length by symbol: by length, then symbol, each code the sum of the Kraft shares before it."""
    top, share, out = max(lengths.values(), default=0), 0, {}
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        out[s] = (share >> (top - lengths[s]), lengths[s])
        share += 1 << (top - lengths[s])
    return out


def huffman_compress(data: bytes) -> bytes:
    """01 length symbols (symbol, bits)* code bits; 02 length symbol for one symbol; 00 length data where that is no longer."""
    if not data:
        return _stored(data)
    a = np.frombuffer(data, np.uint8)
    n = np.bincount(a, minlength=256)
    counts = {s: int(n[s]) for s in np.flatnonzero(n).tolist()}
    head = len(data).to_bytes(4, "little")
    if len(counts) == 1:
        return b"\x02" + head + data[:1]
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    size, code = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, k) in codes.items():
        size[s], code[s] = k, c
    each = size[a]
    start = np.cumsum(each) - each
    bits = np.zeros(int(each.sum()), np.uint8)
    for k in range(int(each.max())):
        on = each > k
        bits[start[on] + k] = code[a[on]] >> (each[on] - 1 - k) & 1
    table = b"".join(bytes((s, codes[s][1])) for s in codes)
    packed = b"\x01" + head + len(codes).to_bytes(2, "little") + table + np.packbits(bits).tobytes()
    return packed if len(packed) < len(data) + 5 else _stored(data)


def huffman_decompress(data: bytes) -> bytes:
    size = int.from_bytes(data[1:5], "little")
    if data[0] == 0:
        return data[5 : 5 + size]
    if data[0] == 2:
        return data[5:6] * size
    if data[0] != 1:
        raise ValueError("no Huffman data")
    n = int.from_bytes(data[5:7], "little")
    lengths = dict(zip(data[7 : 7 + 2 * n : 2], data[8 : 7 + 2 * n : 2], strict=True))
    top = max(lengths.values())
    symbol, width = np.zeros(1 << top, np.uint8), np.zeros(1 << top, np.int64)
    for s, (c, k) in canonical_codes(lengths).items():
        symbol[c << (top - k) : (c + 1) << (top - k)] = s
        width[c << (top - k) : (c + 1) << (top - k)] = k
    coded = np.frombuffer(data + bytes(4), np.uint8, offset=7 + 2 * n).astype(np.int64)
    four = coded[:-3] << 24 | coded[1:-2] << 16 | coded[2:-1] << 8 | coded[3:]
    # What a code beginning at each bit would be, then a walk from code to code.
    window = np.stack([four >> (32 - top - k) & ((1 << top) - 1) for k in range(8)], axis=1).ravel()
    steps, at, i = width[window].tolist(), [], 0
    for _ in range(size):
        at.append(i)
        i += steps[i]
    return symbol[window[at]].tobytes()


def transform(data: bytes, kind: str = "auto") -> bytes:
    """A marker byte and what it says: 00 as it is, 01 MTF and zero runs, 03 LZ, 04 Huffman, 05 Huffman of LZ, 06 LZ of Huffman."""
    if kind == "mtf":
        return b"\x01" + len(data).to_bytes(4, "little") + zero_rle_encode(mtf_encode(data))
    made = {"lz": lambda: b"\x03" + lz_compress(data), "huffman": lambda: b"\x04" + huffman_compress(data), "lz_huffman": lambda: b"\x05" + huffman_compress(lz_compress(data)), "huffman_lz": lambda: b"\x06" + lz_compress(huffman_compress(data))}
    if kind in made:
        return made[kind]()
    if kind == "stored":
        return _stored(data)
    if kind == "block":
        ordered, places = block_sort(data)
        a, b = zero_rle_encode(mtf_encode(ordered)), zero_rle_encode(mtf_encode(places))
        body = b"\x02" + len(data).to_bytes(4, "little") + (256).to_bytes(4, "little") + len(a).to_bytes(4, "little") + a + len(b).to_bytes(4, "little") + b
        return body if len(body) < len(data) else transform(data)
    best = b"\x03" + lz_compress(data)
    return best if len(best) < len(data) + 5 else _stored(data)


def untransform(data: bytes) -> bytes:
    """One dispatcher for every marker, FF (zlib) included."""
    if not data:
        raise ValueError("no transform")
    body = data[1:]
    if data[0] == 0:
        return data[5 : 5 + int.from_bytes(data[1:5], "little")]
    if data[0] == 1:
        return mtf_decode(zero_rle_decode(data[5:]))[: int.from_bytes(data[1:5], "little")]
    if data[0] == 2:
        block = int.from_bytes(data[5:9], "little")
        n = int.from_bytes(data[9:13], "little")
        ordered = mtf_decode(zero_rle_decode(data[13 : 13 + n]))
        places = mtf_decode(zero_rle_decode(data[17 + n : 17 + n + int.from_bytes(data[13 + n : 17 + n], "little")]))
        return block_unsort(ordered, places, block)[: int.from_bytes(data[1:5], "little")]
    if data[0] == 0xFF:
        return zlib.decompress(body)
    undo = {3: lz_decompress, 4: huffman_decompress, 5: lambda x: lz_decompress(huffman_decompress(x)), 6: lambda x: huffman_decompress(lz_decompress(x))}
    if data[0] not in undo:
        raise ValueError(f"unknown transform {data[0]:#x}")
    return undo[data[0]](body)
