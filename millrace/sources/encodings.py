"""Column encodings: plain, frame of reference, dictionary and run-length.

A column chunk is an array of whole numbers (int32, int64), float64 or byte
strings; nulls hold 0 or an empty string and are kept apart. All numbers are
little-endian.

=====  =====================================================================
PLAIN  the values; strings as their total length, n + 1 offsets, and bytes
FOR    least value, width in bits, packed differences (whole numbers only)
DICT   sorted distinct values (plain), width, packed places in them
RLE    number of runs, their values, their lengths (fixed-width types only)
=====  =====================================================================

Doubles are told apart by their bits, so -0.0 and every NaN survive.
"""

from __future__ import annotations

import struct

import numpy as np

from millrace.errors import EngineError

PLAIN, FOR, DICT, RLE = "PLAIN", "FOR", "DICT", "RLE"
#: In the order in which equal sizes are decided.
ENCODINGS = (PLAIN, FOR, DICT, RLE)


def width_for(largest: int) -> int:
    """Bits that hold every value up to ``largest``."""
    return int(largest).bit_length()


def packed_size(n: int, width: int) -> int:
    return (n * width + 7) // 8


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned 64-bit values in ``width`` bits each, the lowest bit first; width 0 takes no bytes."""
    if width == 0 or not len(values):
        return b""
    bits = np.unpackbits(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, n: int, width: int) -> np.ndarray:
    if width == 0 or not n:
        return np.zeros(n, dtype=np.uint64)
    if len(packed) < packed_size(n, width):
        raise EngineError("packed values are cut short")
    bits = np.unpackbits(np.frombuffer(packed, np.uint8, packed_size(n, width)), bitorder="little", count=n * width).reshape(n, width)
    full = np.zeros((n, 64), dtype=np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u8").ravel()


def _is_string(values: np.ndarray) -> bool:
    return values.dtype == object


def _keys(values: np.ndarray) -> np.ndarray:
    """What tells values apart."""
    return values.view(np.int64) if values.dtype == np.float64 else values


def plain_size(values: np.ndarray) -> int:
    return 8 + 4 * (len(values) + 1) + sum(map(len, values)) if _is_string(values) else values.nbytes


def _plain(values: np.ndarray) -> bytes:
    if not _is_string(values):
        return values.astype(values.dtype.newbyteorder("<")).tobytes()
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int64)))
    if offsets[-1] >= 1 << 32:
        raise EngineError("a chunk holds 4 GiB of strings at most")
    return struct.pack("<Q", int(offsets[-1])) + offsets.astype("<u4").tobytes() + b"".join(values)


def _read_plain(data: bytes, at: int, n: int, dtype: np.dtype) -> tuple[np.ndarray, int]:
    if dtype != object:
        end = at + n * dtype.itemsize
        if end > len(data):
            raise EngineError("a chunk is cut short")
        return np.frombuffer(data, dtype.newbyteorder("<"), n, at).astype(dtype), end
    (size,) = struct.unpack_from("<Q", data, at)
    offsets = np.frombuffer(data, "<u4", n + 1, at + 8).tolist()
    base = at + 8 + 4 * (n + 1)
    if base + size > len(data):
        raise EngineError("a chunk is cut short")
    out = np.empty(n, dtype=object)
    out[:] = [data[base + a : base + b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out, base + size


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not _is_string(values):
        kept, places = np.unique(_keys(values), return_inverse=True)
        if values.dtype != np.float64:
            return kept, places
        # In the order of values, NaN last, those that are equal in the order of their bits.
        order = np.lexsort((kept, kept.view(np.float64)))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return kept[order].view(np.float64), rank[places]
    kept = sorted(set(values))
    at = {v: k for k, v in enumerate(kept)}
    out = np.empty(len(kept), dtype=object)
    out[:] = kept
    return out, np.array([at[v] for v in values], dtype=np.int64)


def _runs(values: np.ndarray) -> np.ndarray:
    """First places of runs of equal values."""
    k = _keys(values)
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))


def fits(encoding: str, values: np.ndarray) -> bool:
    """Whether values of this type can be encoded so."""
    return not (encoding == FOR and values.dtype.kind != "i" or encoding == RLE and _is_string(values))


def _range(values: np.ndarray) -> tuple[int, int]:
    return (int(values.min()), int(values.max())) if len(values) else (0, 0)


def estimate(encoding: str, values: np.ndarray) -> int:
    """The exact size of the encoded values."""
    if not fits(encoding, values):
        raise EngineError(f"{encoding} does not take {values.dtype}")
    if encoding == PLAIN:
        return plain_size(values)
    if encoding == FOR:
        low, high = _range(values)
        return 9 + packed_size(len(values), width_for(high - low))
    if encoding == DICT:
        kept, _ = _distinct(values)
        return 5 + plain_size(kept) + packed_size(len(values), width_for(max(0, len(kept) - 1)))
    return 4 + len(_runs(values)) * (values.itemsize + 4)


def encode(encoding: str, values: np.ndarray) -> bytes:
    if not fits(encoding, values):
        raise EngineError(f"{encoding} does not take {values.dtype}")
    if encoding == PLAIN:
        return _plain(values)
    if encoding == FOR:
        low, high = _range(values)
        width = width_for(high - low)
        with np.errstate(over="ignore"):
            above = values.astype(np.int64).view(np.uint64) - np.int64(low).astype(np.uint64)
        return struct.pack("<qB", low, width) + pack(above, width)
    if encoding == DICT:
        kept, places = _distinct(values)
        width = width_for(max(0, len(kept) - 1))
        return struct.pack("<I", len(kept)) + _plain(kept) + struct.pack("<B", width) + pack(places.astype(np.uint64), width)
    first = _runs(values)
    lengths = np.diff(np.concatenate((first, [len(values)])))
    return struct.pack("<I", len(first)) + _plain(values[first]) + lengths.astype("<u4").tobytes()


def encode_best(values: np.ndarray) -> tuple[str, bytes]:
    """The smallest encoding; of equal ones the first of :data:`ENCODINGS`."""
    best = min((e for e in ENCODINGS if fits(e, values)), key=lambda e: estimate(e, values))
    return best, encode(best, values)


def decode(encoding: str, data: bytes, n: int, dtype: np.dtype) -> np.ndarray:
    """``n`` values of ``dtype`` (object: byte strings)."""
    dtype = np.dtype(dtype)
    try:
        if encoding == PLAIN:
            return _read_plain(data, 0, n, dtype)[0]
        if encoding == FOR:
            low, width = struct.unpack_from("<qB", data)
            with np.errstate(over="ignore"):
                return (unpack(data[9:], n, width) + np.int64(low).astype(np.uint64)).view(np.int64).astype(dtype)
        if encoding == DICT:
            (size,) = struct.unpack_from("<I", data)
            kept, at = _read_plain(data, 4, size, dtype)
            places = unpack(data[at + 1 :], n, data[at]).astype(np.int64)
            return kept[places]
        if encoding == RLE:
            (runs,) = struct.unpack_from("<I", data)
            values, at = _read_plain(data, 4, runs, dtype)
            out = np.repeat(values, np.frombuffer(data, "<u4", runs, at))
            if len(out) != n:
                raise EngineError("runs do not add up to the chunk's rows")
            return out
    except (struct.error, ValueError, IndexError) as e:
        raise EngineError(f"a chunk cannot be decoded: {e}") from e
    raise EngineError(f"unknown encoding: {encoding}")
