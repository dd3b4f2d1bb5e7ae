"""Hashed sparse features of texts, for the two classifiers."""

from __future__ import annotations

import re
import zlib

import numpy as np

BITS = 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Digits say nothing by themselves.
NUMBER = re.compile(r"\d+")


def tokens(text: str | None) -> list[str]:
    """Lower-case words and runs of punctuation; numbers are one token."""
    return TOKEN.findall(NUMBER.sub("0", (text or "").lower()))


def hashed(text: str | None, bits: int = BITS, bigrams: bool = True, stem: int = 0, known: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's unigrams, bigrams (those of one word twice also as such), and word beginnings of `stem` characters; values are 1 + log of the count, of length 1 together.

    known: keeps token -> hash from one text to the next.
    """
    words = tokens(text)
    known = {} if known is None else known
    for w in set(words):
        if w not in known:
            if len(known) > 400_000:
                known.clear()
            known[w] = zlib.crc32(w.encode("utf-8", "replace"))
    try:
        code = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:  # cleared on the way
        code = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
    parts = [code * np.uint64(0x9E3779B97F4A7C15)]
    if bigrams and len(code) > 1:
        parts.append((code[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (code[1:] * np.uint64(0x165667B19E3779F9)) + np.uint64(1))
        parts.append(np.full(int((code[:-1] == code[1:]).sum()), 0x27D4EB2F165667C5, np.uint64))  # a word twice in a row, whichever it is
    if stem:
        parts.append(np.fromiter({zlib.crc32(b"^" + w[:stem].encode("utf-8", "replace")) for w in set(words) if len(w) > stem}, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    index, count = np.unique(np.concatenate(parts) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - bits), return_counts=True)
    value = 1 + np.log(count)
    return index.astype(np.int64), value / np.sqrt((value * value).sum()) if len(value) else value
