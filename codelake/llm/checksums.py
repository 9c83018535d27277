"""CRC-32C of many messages at once, vectorized over blocks of them.

A CRC that starts from 0 is linear: zeros in front change nothing, and a block's CRC is carried past the blocks after
it by a fixed linear map. So messages are cut into blocks, all blocks run side by side, and the results are folded.
"""

import numpy as np

from codelake.llm.textkernel import ranges

POLYNOMIAL = 0x82F63B78  # fixed value: CRC-32C, bits reversed
MASK_DELTA = 0xA282EAD8  # fixed value: what masking adds to a rotated checksum
WORDS = 256  # 16-bit words in a block


def _after_two_bytes() -> np.ndarray:
    crc = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1).astype(np.uint32)
    return crc


_TABLE = _after_two_bytes()


def _step(crc: np.ndarray, word) -> np.ndarray:
    return _TABLE[(crc ^ word) & 0xFFFF] ^ (crc >> np.uint32(16))


def _past_a_block() -> np.ndarray:
    """For each byte of a checksum, what its 256 values become past a block of zeros."""
    crc = (np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]).copy()
    for _ in range(WORDS):
        crc = _step(crc, np.uint32(0))
    return crc


_PAST = _past_a_block()


def crc32c(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of messages given one after another as little-endian 16-bit words, `sizes` words each."""
    sizes = sizes.astype(np.int64)
    count = -(-sizes // WORDS)
    first = np.cumsum(count) - count
    grid = np.zeros(int(count.sum()) * WORDS, np.uint16)
    begin = (first + count) * WORDS - sizes
    grid[ranges(begin, sizes)] = words
    for k in (0, 1):  # starting from all ones is the same as inverting the first four bytes
        grid[begin[sizes > k] + k] ^= 0xFFFF
    lanes = np.ascontiguousarray(grid.reshape(-1, WORDS).T).astype(np.uint32)
    crc = np.zeros(lanes.shape[1], np.uint32)
    for column in lanes:
        crc = _step(crc, column)
    out = np.zeros(len(sizes), np.uint32)
    order = np.argsort(-count, kind="stable")
    ordered = count[order]
    for k in range(int(count.max(initial=0))):
        live = order[: int(np.searchsorted(-ordered, -k, side="left"))]  # messages with more than k blocks
        x = out[live]
        x = _PAST[0][x & 255] ^ _PAST[1][(x >> 8) & 255] ^ _PAST[2][(x >> 16) & 255] ^ _PAST[3][x >> 24]
        out[live] = x ^ crc[first[live] + k]
    out[sizes == 1] ^= np.uint32(0xFFFF)  # the other half of the initial ones
    return np.where(sizes > 0, ~out, np.uint32(0)).astype(np.uint32)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
