"""MD5 of many short texts at once, for orders by a seeded hash inside tasks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

_SINE = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts that are hashed at once, so that what a step touches stays in a core's cache; bytes of a text that fits one block.
_AT_ONCE, _ONE_BLOCK = 8_192, 55


class Texts:
    """Texts that are hashed several times, each time with another tail."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        """Their bytes by length, four to a word."""
        held = texts.cast(pa.large_binary()).combine_chunks()
        held = held if isinstance(held, pa.Array) else pa.concat_arrays(held.chunks)
        self.texts, self.n = held, len(held)
        ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + self.n + 1]
        data, sizes = np.frombuffer(held.buffers()[2] or b"", np.uint8), np.diff(ends)
        self.groups = []
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            words = None
            if size < _ONE_BLOCK:
                spread = np.zeros((len(rows), -(-size // 4) * 4), np.uint8)
                for i in range(size):
                    spread[:, i] = data[ends[rows] + i]
                words = np.ascontiguousarray(spread.view("<u4").T)
            self.groups.append((size, rows, words))

    def digests(self, tail: bytes) -> np.ndarray:
        """(n, 2): the digests of the texts followed by a tail as two numbers, which order like the digests in hexadecimal."""
        out = np.empty((self.n, 2), np.uint64)
        for size, rows, words in self.groups:
            if words is None or size + len(tail) > _ONE_BLOCK:
                found = b"".join(hashlib.md5(self.texts[i].as_py() + tail).digest() for i in rows.tolist())
                out[rows] = np.frombuffer(found, ">u8").reshape(-1, 2)
                continue
            rest = np.frombuffer((bytes(size) + tail + b"\x80").ljust(56, b"\0") + ((size + len(tail)) * 8).to_bytes(8, "little"), "<u4")
            for at in range(0, len(rows), _AT_ONCE):
                own = words[:, at : at + _AT_ONCE]
                block = [own[i] | rest[i] if i < len(own) else rest[i] for i in range(16)]
                out[rows[at : at + _AT_ONCE]] = _of_block(block, own.shape[1] if len(own) else 1)
        return out


def _of_block(block: list[np.ndarray], n: int) -> np.ndarray:
    """(n, 2): digests of one block of sixteen words, each a number a text or one for all."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    start = (a, b, c, d)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += block[g]
        f += np.uint32(_SINE[i])
        turn = _TURNS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    words = np.stack([x + y for x, y in zip((a, b, c, d), start, strict=True)], axis=1)
    return np.ascontiguousarray(words.astype("<u4")).view(">u8").astype(np.uint64)
