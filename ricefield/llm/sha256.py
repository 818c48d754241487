"""SHA-256 with states that can be kept: many hashes side by side in numpy lanes.

The state of a hash between two 64-byte blocks is eight 32-bit words, so it can be stored
beside a node and picked up later by another task, which ``hashlib`` objects do not allow.
Digests as hex text are 64 bytes, one block each.
"""

from __future__ import annotations

import numpy as np

LANES = 16_384


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _root_bits(prime: int, power: int) -> int:
    """The first 32 bits after the point of the square or cube root of a prime."""
    goal, low, high = prime << (32 * power), 0, 1 << 40
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**power <= goal else (low, middle)
    return low & 0xFFFFFFFF


ROUND = [np.uint32(_root_bits(p, 3)) for p in _primes(64)]
START = np.array([_root_bits(p, 2) for p in _primes(8)], dtype=np.uint32)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _block(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    w = [words[i] for i in range(16)]
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        s0 = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
        s1 = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
        w.append(w[i - 16] + s0 + w[i - 7] + s1)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        s1 = _turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)
        t1 = h + s1 + (g ^ (e & (f ^ g))) + ROUND[i] + w[i]
        s0 = _turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)
        t2 = s0 + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + t1, c, b, a, t1 + t2
    return np.stack([a, b, c, d, e, f, g, h]) + state


def absorb(states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one more block (n, 16) each."""
    out = np.empty_like(states)
    for at in range(0, len(states), LANES):
        part = slice(at, at + LANES)
        out[part] = _block(np.ascontiguousarray(states[part].T), np.ascontiguousarray(words[part].T)).T
    return out


def fresh(n: int) -> np.ndarray:
    return np.tile(START, (n, 1))


def finish(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests (n, 8) of hashes that have taken in ``blocks`` whole blocks each."""
    words = np.zeros((len(states), 16), dtype=np.uint32)
    words[:, 0] = 0x80000000
    bits = blocks.astype(np.uint64) * np.uint64(512)
    words[:, 14], words[:, 15] = (bits >> np.uint64(32)), (bits & np.uint64(0xFFFFFFFF))
    return absorb(states, words)


_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def hex_words(digests: np.ndarray) -> np.ndarray:
    """The blocks (n, 16) that digests (n, 8) are as lowercase hex text."""
    raw = digests.astype(">u4").view(np.uint8).reshape(-1, 32)
    text = np.empty((len(raw), 64), dtype=np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[raw >> 4], _HEX[raw & 15]
    return text.view(">u4").astype(np.uint32)


def words_of_text(data: bytes) -> np.ndarray:
    """Blocks (n, 16) of a text of whole blocks."""
    return np.frombuffer(data, dtype=">u4").astype(np.uint32).reshape(-1, 16)


def text_of_words(words: np.ndarray) -> bytes:
    return words.astype(">u4").tobytes()
