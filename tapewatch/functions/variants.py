"""Variants as Python values, in Arrow batches.

Rules made of hundreds of tests on one value cost a pass over it for each test as column expressions, and plans that
take long to make; read once, a test is a look into a dictionary.
"""

from __future__ import annotations

import struct

import pyarrow as pa

#: Key lists of values that are kept; values of one table mostly share theirs.
KEPT = 1024
_SIZES = {3: 1, 4: 2, 5: 4, 6: 8, 8: 4, 9: 8, 10: 16}
_known: dict[bytes, list[str]] = {}


def _numbers(data: bytes, at: int, n: int, size: int) -> list[int]:
    if size == 1:
        return list(data[at : at + n])
    return [int.from_bytes(data[k : k + size], "little") for k in range(at, at + n * size, size)]


def _keys(metadata: bytes) -> list[str]:
    if (got := _known.get(metadata)) is None:
        if len(_known) >= KEPT:
            _known.clear()
        size = (metadata[0] >> 6) + 1
        n = int.from_bytes(metadata[1 : 1 + size], "little")
        start = 1 + (n + 2) * size
        ends = _numbers(metadata, 1 + size, n + 1, size)
        got = _known[metadata] = [metadata[start + a : start + b].decode() for a, b in zip(ends, ends[1:], strict=False)]
    return got


def _decimal(unscaled: int, scale: int) -> int | float:
    """As `jsontree.kind`: whole from 19 digits on, as shorter decimals without a fraction were written with one."""
    whole, rest = divmod(abs(unscaled), 10**scale)
    if not rest and whole >= 10**18:
        return whole if unscaled > 0 else -whole
    return unscaled / 10**scale


def _value(data: bytes, at: int, keys: list[str]) -> object:
    head = data[at]
    basic, info = head & 3, head >> 2
    at += 1
    if basic == 1:
        return data[at : at + info].decode()
    if basic == 2:
        size, of_id, of_offset = 4 if info & 16 else 1, (info >> 2 & 3) + 1, (info & 3) + 1
        n = int.from_bytes(data[at : at + size], "little")
        ids = _numbers(data, at + size, n, of_id)
        at += size + n * of_id
        start = at + (n + 1) * of_offset
        return {keys[k]: _value(data, start + o, keys) for k, o in zip(ids, _numbers(data, at, n, of_offset), strict=True)}
    if basic == 3:
        size, of_offset = 4 if info & 4 else 1, (info & 3) + 1
        n = int.from_bytes(data[at : at + size], "little")
        at += size
        start = at + (n + 1) * of_offset
        return [_value(data, start + o, keys) for o in _numbers(data, at, n, of_offset)]
    if info < 3:
        return (None, True, False)[info]
    if info < 7:
        return int.from_bytes(data[at : at + _SIZES[info]], "little", signed=True)
    if info == 7:
        return struct.unpack_from("<d", data, at)[0]
    if info in _SIZES:
        return _decimal(int.from_bytes(data[at + 1 : at + 1 + _SIZES[info]], "little", signed=True), data[at])
    if info == 16:
        return data[at + 4 : at + 4 + int.from_bytes(data[at : at + 4], "little")].decode()
    raise ValueError(f"a JSON text has no value of type {info}")


def values(column: pa.StructArray) -> list[object]:
    """Variants made from JSON: maps (keys in the variant's order), lists, strings, flags, None, ints and floats.

    Numbers with a fraction, an exponent or more than 38 digits are floats, as `jsontree.kind` tells them; null is None.
    """
    datas, names = (column.flatten()[column.type.get_field_index(n)].to_pylist() for n in ("value", "metadata"))
    return [None if d is None else _value(d, 0, _keys(m)) for d, m in zip(datas, names, strict=True)]
