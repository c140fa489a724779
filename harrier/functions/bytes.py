"""Functions over file contents, as Arrow-batched UDFs: no builtin reads bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

_LOGIN = StructType()
for _name, _type in (("typ", IntegerType()), ("pid", IntegerType()), ("line", StringType()), ("user", StringType()), ("host", StringType()), ("time", LongType())):
    _LOGIN = _LOGIN.add(_name, _type)
_ELF = StructType()
for _name, _type in (("machine", IntegerType()), ("is_static", BooleanType()), ("stripped", BooleanType()), ("interp", StringType()), ("section_count", IntegerType()), ("has_rwx_segment", BooleanType()), ("entry", StringType())):
    _ELF = _ELF.add(_name, _type)


def entropy(data: bytes) -> float:
    """Shannon entropy in bits of the bytes, 0 to 8."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / max(1, len(data))
    return float(-(p * np.log2(p)).sum() + 0.0)


def window_entropy(data: bytes, width: int) -> tuple[float, int]:
    """The largest entropy of a window that moves by one byte, and its offset."""
    if len(data) <= width:
        return entropy(data), 0
    b = np.frombuffer(data, np.uint8)
    table = np.arange(width + 1) * np.log2(np.maximum(1, np.arange(width + 1)))
    counts = np.bincount(b[:width], minlength=256)
    total, best, at = table[counts].sum(), -np.inf, 0
    for k in range(len(b) - width + 1):
        if (e := np.log2(width) - total / width) > best + 1e-12:
            best, at = e, k
        if k + width < len(b):
            out, new = b[k], b[k + width]
            total += table[counts[out] - 1] - table[counts[out]]
            counts[out] -= 1
            total += table[counts[new] + 1] - table[counts[new]]
            counts[new] += 1
    return float(best), at


@F.pandas_udf(DoubleType())
def byte_entropy(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in content:
        yield s.map(entropy, na_action="ignore")


@F.pandas_udf(ArrayType(_LOGIN))
def utmp_records(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Login records of 384 bytes each; an incomplete last one is ignored."""
    kind = np.dtype([("typ", "<i2"), ("_", "V2"), ("pid", "<i4"), ("line", "S32"), ("id", "S4"), ("user", "S32"), ("host", "S256"), ("exit", "V4"), ("session", "<i4"), ("time", "<i4"), ("usec", "<i4"), ("addr", "V16"), ("rest", "V20")])
    text = lambda b: b.split(b"\0")[0].decode("utf-8", "replace")

    def one(data: bytes) -> list[dict]:
        rows = np.frombuffer(data[: len(data) // 384 * 384], kind)
        return [{"typ": int(r["typ"]), "pid": int(r["pid"]), "line": text(r["line"]), "user": text(r["user"]), "host": text(r["host"]), "time": int(r["time"])} for r in rows]

    for s in content:
        yield s.map(one, na_action="ignore")


@F.pandas_udf(_ELF)
def elf_info(content: pd.Series) -> pd.DataFrame:
    """Header facts of 64-bit little-endian ELF files; null for anything else."""
    import struct

    def one(b: bytes | None) -> tuple:
        if not b or b[:6] != b"\x7fELF\x02\x01" or len(b) < 64:
            return (None,) * 7
        machine, entry, phoff, shoff, phsize, phnum, shsize, shnum = struct.unpack_from("<2xH4xQQQ6xHHHH", b, 16)
        interp, rwx = None, False
        for k in range(phnum):
            at = phoff + k * phsize
            if at + 56 > len(b):
                break
            kind, flags, offset, length = struct.unpack_from("<IIQ16xQ", b, at)
            rwx |= kind == 1 and flags & 7 == 7
            if kind == 3:
                interp = b[offset : offset + length].split(b"\0")[0].decode("utf-8", "replace")
        symbols = any(struct.unpack_from("<4xI", b, shoff + k * shsize)[0] == 2 for k in range(shnum) if shoff + k * shsize + 8 <= len(b))
        return machine, interp is None, not symbols, interp, shnum, rwx, str(entry)

    return pd.DataFrame([one(b) for b in content], columns=["machine", "is_static", "stripped", "interp", "section_count", "has_rwx_segment", "entry"])


# -- BLAKE3: a binary tree over chunks of 1,024 bytes, all chunks of a batch at once

# The hash's initial words, the order of a block's words from round to round, its flags
BLAKE3_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
BLAKE3_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8


def _mix(v: np.ndarray, at: tuple[int, int, int, int], x: np.ndarray, y: np.ndarray) -> None:
    a, b, c, d = at
    for word, far, near in ((x, 16, 12), (y, 8, 7)):
        v[a] += v[b] + word
        t = v[d] ^ v[a]
        v[d] = t >> np.uint32(far) | t << np.uint32(32 - far)
        v[c] += v[d]
        t = v[b] ^ v[c]
        v[b] = t >> np.uint32(near) | t << np.uint32(32 - near)


def _compress(chain: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Next chaining words (8, n) from (8, n), blocks (16, n) and each column's counter, length and flags."""
    v = np.empty((16, chain.shape[1]), np.uint32)
    v[:8] = chain
    v[8:12] = np.array(BLAKE3_IV[:4], np.uint32)[:, None]
    v[12], v[13], v[14], v[15] = counter & 0xFFFFFFFF, counter >> 32, length, flags
    order = list(range(16))
    for _ in range(7):
        m = [block[k] for k in order]
        for k in range(4):
            _mix(v, (k, 4 + k, 8 + k, 12 + k), m[2 * k], m[2 * k + 1])
        for k in range(4):
            _mix(v, (k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4), m[8 + 2 * k], m[9 + 2 * k])
        order = [order[k] for k in BLAKE3_ORDER]
    return v[:8] ^ v[8:]


def blake3_many(contents: list[bytes], most: int = 1 << 14) -> list[str]:
    """BLAKE3 digests in lower-case hexadecimal; ``most`` chunks are compressed together."""
    sizes = np.array([len(c) for c in contents], np.int64)
    counts = np.maximum(1, -(-sizes // 1024))
    owner = np.repeat(np.arange(len(contents)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    chains = np.empty((8, len(owner)), np.uint32)
    for low in range(0, len(owner), most):
        own, at = owner[low : low + most], place[low : low + most]
        data = np.zeros((len(own), 1024), np.uint8)
        held = np.minimum(1024, sizes[own] - 1024 * at)
        for row, (o, p, n) in enumerate(zip(own, at, held)):
            data[row, :n] = np.frombuffer(contents[o], np.uint8, n, 1024 * p) if n else 0
        words = data.view("<u4").astype(np.uint32).reshape(len(own), 16, 16)
        chain = np.repeat(np.array(BLAKE3_IV, np.uint32)[:, None], len(own), 1)
        last = np.maximum(0, (held - 1) // 64)
        for b in range(int(last.max()) + 1):
            live = np.flatnonzero(last >= b)
            ends = last[live] == b
            flags = np.where(ends, CHUNK_END, 0) | (CHUNK_START if b == 0 else 0) | np.where(ends & (counts[own[live]] == 1), ROOT, 0)
            length = np.where(ends, held[live] - 64 * b, 64)
            chain[:, live] = _compress(chain[:, live], np.ascontiguousarray(words[live, b].T), at[live], length, flags)
        chains[:, low : low + len(own)] = chain
    # parents of neighbours, level by level; one without a neighbour moves up as it is
    while (counts > 1).any():
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < counts[owner]))
        keep = np.flatnonzero(place % 2 == 0)
        up = chains[:, keep]
        if len(left):
            block = np.concatenate([chains[:, left], chains[:, left + 1]])
            start = np.repeat(np.array(BLAKE3_IV, np.uint32)[:, None], len(left), 1)
            flags = PARENT | np.where(counts[owner[left]] == 2, ROOT, 0)
            up[:, np.searchsorted(keep, left)] = _compress(start, block, np.zeros(len(left), np.int64), np.full(len(left), 64), flags)
        chains, owner, place, counts = up, owner[keep], place[keep] // 2, (counts + 1) // 2
    return [chains[:, k].astype("<u4").tobytes().hex() for k in range(len(contents))]


@F.pandas_udf(StringType())
def blake3(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """BLAKE3 of binary contents; null for null. A task holds an Arrow batch of contents and 16 MB of chunks."""
    for s in content:
        there = s.dropna()
        yield pd.Series(blake3_many([bytes(x) for x in there]), index=there.index, dtype=object).reindex(s.index) if len(there) else pd.Series([None] * len(s), dtype=object)
