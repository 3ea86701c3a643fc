"""Integer codecs and front coding, for comparing sizes; tables themselves are Parquet."""

from __future__ import annotations

BLOCK = 128
#: Simple-9 selectors: values per word and bits of each.
SIMPLE9 = [(28, 1), (14, 2), (9, 3), (7, 4), (5, 5), (4, 7), (3, 9), (2, 14), (1, 28)]


class Corrupt(ValueError):
    pass


def put_varint(out: bytearray, v: int) -> None:
    while v >= 128:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Corrupt("varint")
        b = data[at]
        at += 1
        v |= (b & 127) << shift
        if b < 128:
            return v, at
        shift += 7


def varint_encode(values: list[int]) -> bytes:
    out = bytearray()
    for v in values:
        put_varint(out, v)
    return bytes(out)


def varint_decode(data: bytes, n: int) -> list[int]:
    out, at = [], 0
    for _ in range(n):
        v, at = get_varint(data, at)
        out.append(v)
    return out


def simple9_encode(values: list[int]) -> bytes:
    """28-bit words with a 4-bit selector; a value of 28 bits or more follows selector 15 as a whole word."""
    out, i = bytearray(), 0
    while i < len(values):
        for s, (count, bits) in enumerate(SIMPLE9):
            part = values[i : i + count]
            if len(part) == count and max(part) < 1 << bits:
                word = s << 28
                for k, v in enumerate(part):
                    word |= v << k * bits
                out += word.to_bytes(4, "little")
                i += count
                break
        else:
            out += (15 << 28).to_bytes(4, "little") + values[i].to_bytes(4, "little")
            i += 1
    return bytes(out)


def simple9_decode(data: bytes, n: int) -> list[int]:
    out, at = [], 0
    while len(out) < n:
        if at + 4 > len(data):
            raise Corrupt("simple9")
        word = int.from_bytes(data[at : at + 4], "little")
        at += 4
        s = word >> 28
        if s == 15:
            if at + 4 > len(data):
                raise Corrupt("simple9")
            out.append(int.from_bytes(data[at : at + 4], "little"))
            at += 4
        elif s >= len(SIMPLE9):
            raise Corrupt("simple9 selector")
        else:
            count, bits = SIMPLE9[s]
            out += [word >> k * bits & (1 << bits) - 1 for k in range(count)]
    return out[:n]


def _pack(values: list[int], bits: int) -> bytes:
    big = 0
    for k, v in enumerate(values):
        big |= (v & (1 << bits) - 1) << k * bits
    return big.to_bytes((len(values) * bits + 7) // 8, "little")


def _unpack(data: bytes, at: int, n: int, bits: int) -> tuple[list[int], int]:
    size = (n * bits + 7) // 8
    if at + size > len(data):
        raise Corrupt("packed block")
    big = int.from_bytes(data[at : at + size], "little")
    return [big >> k * bits & (1 << bits) - 1 for k in range(n)], at + size


def bitpacked_encode(values: list[int]) -> bytes:
    out = bytearray()
    for i in range(0, len(values), BLOCK):
        part = values[i : i + BLOCK]
        bits = max(v.bit_length() for v in part)
        out.append(bits)
        out += _pack(part, bits)
    return bytes(out)


def bitpacked_decode(data: bytes, n: int) -> list[int]:
    out, at = [], 0
    while len(out) < n:
        if at >= len(data):
            raise Corrupt("bit width")
        part, at = _unpack(data, at + 1, min(BLOCK, n - len(out)), data[at])
        out += part
    return out


def pfor_encode(values: list[int]) -> bytes:
    """Blocks of 128 packed at a width that all but a tenth fit; the rest follow as (place, high bits)."""
    out = bytearray()
    for i in range(0, len(values), BLOCK):
        part = values[i : i + BLOCK]
        widths = sorted(v.bit_length() for v in part)
        bits = widths[len(part) - 1 - len(part) // 10]
        over = [(k, v >> bits) for k, v in enumerate(part) if v.bit_length() > bits]
        out += bytes([bits, len(over)]) + _pack(part, bits)
        for k, high in over:
            out.append(k)
            put_varint(out, high)
    return bytes(out)


def pfor_decode(data: bytes, n: int) -> list[int]:
    out, at = [], 0
    while len(out) < n:
        if at + 2 > len(data):
            raise Corrupt("block head")
        bits, count = data[at], data[at + 1]
        part, at = _unpack(data, at + 2, min(BLOCK, n - len(out)), bits)
        for _ in range(count):
            if at >= len(data) or data[at] >= len(part):
                raise Corrupt("exception")
            k = data[at]
            high, at = get_varint(data, at + 1)
            part[k] |= high << bits
        out += part
    return out


CODECS = {"varint": (varint_encode, varint_decode), "simple9": (simple9_encode, simple9_decode), "bitpacked": (bitpacked_encode, bitpacked_decode), "pfor": (pfor_encode, pfor_decode)}


def gaps(values: list[int]) -> list[int]:
    return [v - p for p, v in zip([0, *values[:-1]], values)]


def from_gaps(values: list[int]) -> list[int]:
    out, at = [], 0
    for v in values:
        at += v
        out.append(at)
    return out


def front_encode(words: list[str]) -> bytes:
    """Sorted words: bytes shared with the one before, bytes that follow, these bytes."""
    out, before = bytearray(), b""
    for w in words:
        now = w.encode()
        n = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
        put_varint(out, n)
        put_varint(out, len(now) - n)
        out += now[n:]
        before = now
    return bytes(out)


def front_decode(data: bytes, count: int) -> list[str]:
    out, before, at = [], b"", 0
    for _ in range(count):
        n, at = get_varint(data, at)
        size, at = get_varint(data, at)
        if n > len(before) or at + size > len(data):
            raise Corrupt("front coding")
        before = before[:n] + data[at : at + size]
        at += size
        out.append(before.decode())
    return out
