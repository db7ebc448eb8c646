"""Words of a chunk of texts as integer codes, and packed arrays for shuffles of many small numbers."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection, so distinct values stay distinct)."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _MUL[0]
    x = (x ^ (x >> np.uint64(27))) * _MUL[1]
    return x ^ (x >> np.uint64(31))


class Words:
    """codes[starts[i]:starts[i+1]] are the words of text i, numbers into words; null texts have none."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        starts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        self.starts = starts - starts[0]
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.words = coded.dictionary
        empty = pc.index(self.words, "").as_py() if len(self.words) else -1
        if empty >= 0:  # what white space at either end of a text leaves
            full = self.codes != empty
            self.starts = np.r_[0, np.cumsum(full)][self.starts]
            self.codes = self.codes[full]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each entry of words."""
        digest = xxhash.xxh64_digest
        return np.frombuffer(b"".join([digest(w, seed) for w in self.words.cast(pa.large_binary()).to_pylist()]), ">u8").astype(np.uint64)


def pack(**arrays: np.ndarray) -> bytes:
    """Named one-dimensional arrays as bytes: a header, then each array's byte planes, compressed."""
    head, parts = [], []
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        parts.append(squeeze(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""))
        head.append([name, a.dtype.str, len(a), len(parts[-1])])
    top = json.dumps(head).encode()
    return len(top).to_bytes(4, "little") + top + b"".join(parts)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    at = 4 + int.from_bytes(data[:4], "little")
    out = {}
    for name, kind, n, size in json.loads(data[4:at]):
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, n * np.dtype(kind).itemsize))
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).reshape(n) if n else np.empty(0, kind)
        at += size
    return out
