"""Hashed word and character n-gram features of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from spindrift.llm.common import mix64, offsets, ragged

_GOLD = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 2 << 20


def text_slices(texts: list[str | None]):
    """Ranges of consecutive texts of about ``SLICE_BYTES`` together."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE_BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def tokens(texts: list[str | None], letters_only: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens, the token at every place, and how many places each text has.

    Tokens are separated by white space; with ``letters_only`` texts are lower-cased first and
    everything but letters and digits separates.
    """
    column = pc.fill_null(pa.array(texts, pa.string()), "")
    if letters_only:
        column = pc.replace_substring_regex(pc.utf8_lower(column), r"[^\pL\pN]+", " ")
    lists = pc.utf8_split_whitespace(column)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    real = np.array([bool(w) for w in words], dtype=bool)[code] if len(code) else np.zeros(0, dtype=bool)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, kept = offsets(counts), offsets(real.astype(np.int64))
    return words, code[real], kept[ends[1:]] - kept[ends[:-1]]


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def subwords(words: list[str], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its character n-grams of ``low`` to ``high`` characters, the
    word's borders counted as characters; flat, grouped by word, with the number of each."""
    marked = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    starts = offsets(size)[:-1]
    hashes, owner = [word_hashes(words)], [np.arange(len(words))]
    with np.errstate(over="ignore"):
        for n in range(low, high + 1):
            room = np.maximum(0, size - n + 1)
            at = ragged(starts, room)
            h = np.full(len(at), n, dtype=np.uint64)
            for i in range(n):
                h = h * _GOLD + chars[at + i] + np.uint64(1)
            hashes.append(mix64(h))
            owner.append(np.repeat(np.arange(len(words)), room))
    whose = np.concatenate(owner)
    order = np.argsort(whose, kind="stable")
    return np.concatenate(hashes)[order], np.bincount(whose, minlength=len(words)).astype(np.int64)
