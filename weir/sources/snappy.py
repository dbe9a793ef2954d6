"""The published framing of snappy: a stream mark, then chunks of at most 64 KiB, each with a masked CRC-32C of its plain bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: The stream mark, kinds of chunks, the mask of checksums, the reversed polynomial of CRC-32C.
MARK = b"\xff\x06\x00\x00sNaPpY"
COMPRESSED, PLAIN, SKIPPABLE = 0x00, 0x01, 0x80
MASK = 0xA282EAD8
POLYNOMIAL = 0x82F63B78
BLOCK, LANE, SHORT = 1 << 16, 32, 1_000
_CODEC = pa.Codec("snappy")


@lru_cache(1)
def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1)
    return out


@lru_cache(1)
def _list() -> list[int]:
    return _table().tolist()


@lru_cache(16)
def _zeros(n: int) -> np.ndarray:
    """What ``n`` zero bytes (a power of two) make of a state, as a table for each of the state's bytes."""
    if n == 1:
        states = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32)
        return _table()[states & 255] ^ (states >> 8)
    return _after(_zeros(n // 2), _zeros(n // 2))


def _after(zeros: np.ndarray, state: np.ndarray) -> np.ndarray:
    return zeros[0][state & 255] ^ zeros[1][state >> 8 & 255] ^ zeros[2][state >> 16 & 255] ^ zeros[3][state >> 24]


def crc32c(data: bytes) -> int:
    """Lanes of the data run side by side; then neighbours are joined, as a checksum is linear. Zeros in front change nothing,
    once the first four bytes carry the initial state."""
    if len(data) < SHORT:
        state, table = 0xFFFFFFFF, _list()
        for b in data:
            state = table[(state ^ b) & 255] ^ state >> 8
        return state ^ 0xFFFFFFFF
    lanes = 1 << max(-(-len(data) // LANE) - 1, 0).bit_length()
    padded = np.zeros(lanes * LANE, dtype=np.uint8)
    own = padded[len(padded) - len(data) :]
    own[:] = np.frombuffer(data, dtype=np.uint8)
    own[:4] ^= 255
    columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    state, table = np.zeros(lanes, dtype=np.uint32), _table()
    for column in columns:
        state = table[(state ^ column) & 255] ^ (state >> 8)
    width = LANE
    while len(state) > 1:
        state, width = _after(_zeros(width), state[::2]) ^ state[1::2], width * 2
    return int(state[0]) ^ 0xFFFFFFFF


def _masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def chunk(block: bytes) -> bytes:
    """One chunk; what does not shrink by an eighth stays plain."""
    small = _CODEC.compress(block, asbytes=True)
    kind, body = (COMPRESSED, small) if len(small) < len(block) - len(block) // 8 else (PLAIN, block)
    return bytes([kind]) + (len(body) + 4).to_bytes(3, "little") + _masked(crc32c(block)).to_bytes(4, "little") + body


def frame(data: bytes) -> bytes:
    return MARK + b"".join(chunk(data[k : k + BLOCK]) for k in range(0, len(data), BLOCK))


def _size(body: bytes) -> int:
    """The plain size that a compressed block begins with, seven bits a byte."""
    out = 0
    for k, b in enumerate(body[:5]):
        out |= (b & 127) << 7 * k
        if b < 128:
            return out
    raise ValueError("no size")


def unframe(data: bytes) -> bytes:
    """The plain bytes up to the first chunk that is cut, broken or of an unknown kind."""
    out, at = [], 0
    while at + 4 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if len(body) < size or (kind == 0xFF and body != MARK[4:]) or 2 <= kind < SKIPPABLE:
            break
        if kind not in (COMPRESSED, PLAIN):
            continue
        try:
            plain = bytes(body[4:]) if kind == PLAIN else _CODEC.decompress(body[4:], _size(body[4:]), asbytes=True)
        except (ValueError, OSError):
            break
        if _masked(crc32c(plain)) != int.from_bytes(body[:4], "little"):
            break
        out.append(plain)
    return b"".join(out)
