"""Word shingles of whole texts, hashed in numpy on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat, hash_strings, mix64

_RNG = np.random.default_rng(977)
_FACTORS = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words [^\\x20\\x09-\\x0D]+ of the ASCII-lower-cased texts in a row, and each text's end in it."""
    low = pc.ascii_lower(flat(texts).cast(pa.large_string()))
    split = pc.ascii_split_whitespace(low)
    coded = pc.dictionary_encode(split.flatten())
    table = hash_strings(coded.dictionary)
    code = coded.indices.to_numpy()
    real = np.asarray(pc.binary_length(coded.dictionary)) > 0 if len(coded.dictionary) else np.empty(0, bool)
    ends = np.asarray(split.offsets)
    ends = ends - ends[0]
    keep = real[code] if len(code) else np.empty(0, bool)
    if not keep.all():  # splitting leaves empty strings at a text's ends
        ends = np.concatenate(([0], np.cumsum(keep)))[ends]
        code = code[keep]
    return table[code] if len(code) else np.empty(0, np.uint64), ends


def shingle_rows(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Of each text, the ascending distinct hashes of its k-word shingles as signed 64-bit integers.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    hashes, ends = words(texts)
    n = np.diff(ends)
    whole = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k):
        whole += hashes[i : len(whole) + i] * _FACTORS[i]
    whole = mix64(whole).view(np.int64)
    out = []
    for a, m in zip(ends[:-1].tolist(), n.tolist()):
        if m >= k:
            row = np.sort(whole[a : a + m - k + 1])
            out.append(row[np.concatenate(([True], row[1:] != row[:-1]))])
        elif m:
            value = np.append(hashes[a : a + m] * _FACTORS[:m], np.uint64(m * 0x9E3779B1)).sum()
            out.append(mix64(np.array([value], np.uint64)).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out
