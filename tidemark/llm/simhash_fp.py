"""Per-document SimHash fingerprint: 4-word shingles, XXH64 with seed 42."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 4
SEED = 42


def fingerprint(text: bytes | None) -> bytes:
    """Eight big-endian bytes; zero for a text without words.

    ``bytes.lower`` folds A-Z alone and ``bytes.split`` cuts at exactly
    ``[\\x20\\x09-\\x0D]``, so UTF-8 text needs no decoding.
    """
    words = text.lower().split() if text else []
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_digest(joined, SEED)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    spans = zip(starts[: 1 - SHINGLE_WORDS].tolist(), ends[SHINGLE_WORDS - 1 :].tolist())
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in spans]), dtype=np.uint8)
    n = len(raw) // 8
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(raw), 8 << 16):  # bounded: a block of 65,536 shingles
        ones += np.unpackbits(raw[at : at + (8 << 16)]).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()
