"""Bit-exact checksums and hashes that Spark has no function for. Vectorised with NumPy where data is large."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, LongType

_POLYNOMIAL = 0x82F63B78
_MASK_DELTA = 0xA282EAD8
_MULTIPLIER = 0xBF58476D1CE4E5B9


def _castagnoli() -> list[int]:
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (_POLYNOMIAL if byte & 1 else 0)
        table.append(byte)
    return table


_TABLE = _castagnoli()
_TABLE_ARRAY = np.array(_TABLE, np.uint32)
#: Longer data is cut into lanes that advance together; their states are combined afterwards.
_LANES, _LONG = 512, 4096


def _bytewise(state: int, data: bytes) -> int:
    for b in data:
        state = _TABLE[(state ^ b) & 255] ^ state >> 8
    return state


@lru_cache(maxsize=64)
def _skip(zeros: int) -> list[np.ndarray]:
    """What `zeros` zero bytes do to a state, as a table for each of its four bytes. The step is linear over bits."""
    columns = np.array([_TABLE[(1 << i) & 255] ^ (1 << i) >> 8 for i in range(32)], np.uint32)  # one byte

    def apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for i in range(32):
            out ^= np.where(x >> np.uint32(i) & np.uint32(1), matrix[i], np.uint32(0))
        return out

    whole, power = np.uint32(1) << np.arange(32, dtype=np.uint32), columns
    while zeros:
        if zeros & 1:
            whole = apply(power, whole)
        power, zeros = apply(power, power), zeros >> 1
    return [apply(whole, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)]


def crc32c(data: bytes) -> int:
    state, lane = 0xFFFFFFFF, len(data) // _LANES
    if len(data) >= _LONG:
        rows = np.frombuffer(data, np.uint8, lane * _LANES).reshape(_LANES, lane)
        states = np.zeros(_LANES, np.uint32)
        for column in np.ascontiguousarray(rows.T):
            states = _TABLE_ARRAY[(states ^ column) & 255] ^ states >> np.uint32(8)
        tables = _skip(lane)
        for own in states.tolist():
            moved = [int(t[state >> 8 * k & 255]) for k, t in enumerate(tables)]
            state = moved[0] ^ moved[1] ^ moved[2] ^ moved[3] ^ own
        data = data[lane * _LANES :]
    return _bytewise(state, data) ^ 0xFFFFFFFF


def mask(crc: int) -> int:
    """Rotate right by 15 and add a constant, so that a checksum of checksums is no special case."""
    return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + _MASK_DELTA) & 0xFFFFFFFF


def unmask(masked: int) -> int:
    turned = (masked - _MASK_DELTA) & 0xFFFFFFFF
    return (turned >> 17 | turned << 15) & 0xFFFFFFFF


def shard_hash(keys: list[bytes], shards: int = 8) -> np.ndarray:
    """The multiplicative shard number of each key, in wrapping 64-bit arithmetic; shards: a power of two."""
    state = np.full(len(keys), _MULTIPLIER, np.uint64)
    lengths = np.array([len(k) for k in keys])
    for i in range(int(lengths.max(initial=0))):
        more = np.flatnonzero(lengths > i)
        byte = np.array([keys[k][i] for k in more], np.uint64)
        state[more] = (state[more] ^ byte) * np.uint64(_MULTIPLIER)
    state ^= state >> np.uint64(33)
    state *= np.uint64(0xFF51AFD7ED558CCD)
    state ^= state >> np.uint64(33)
    return (state & np.uint64(shards - 1)).astype(np.int32)


@pandas_udf(IntegerType())
def exact_shard(key: pd.Series) -> pd.Series:
    return pd.Series(shard_hash([k.encode() for k in key]))


@pandas_udf(LongType())
def crc32c_of(data: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else crc32c(bytes(x)) for x in data], dtype="Int64")


def bloom_size(elements: int, false_positive_rate: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter for so many elements."""
    bits = -elements * math.log(false_positive_rate) / math.log(2) ** 2
    return math.ceil(bits), math.ceil(bits / elements * math.log(2))
