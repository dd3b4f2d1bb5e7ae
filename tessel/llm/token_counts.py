"""Token counts of texts of any length, by overlap resynchronisation.

A text of over `chunk` characters is encoded as chunks that overlap, each with the offsets of its
tokens. Two neighbours are spliced at a place in their overlap where both encodings begin a token at a
proven boundary: the vocabulary's splitting pattern matches across no such place and its normaliser
composes nothing there, and merges stay inside a match; so what comes after doesn't depend on what came
before, and the left chunk is right up to there and the right one from there on. Proven are places
after white space, and in texts that are in normal form C also those next to a digit, from a letter to
what is none, and from punctuation but the apostrophe to a letter. If an overlap has no such place, it
is doubled, to the point where the right chunk starts with the left one and both are encoded as one;
then the chunk doubles too, so a run of letters without any boundary costs a few times its own encoding.

Texts of one chunk are encoded whole. There the same fact saves most of the work: counts of words
between single spaces or line ends are kept (MEMO of them in each Python worker) and added up. Both
rest on the pattern and the normaliser, so these are read from the vocabulary's file first; with others
than expected every text is encoded whole by the library.

Defined results: null text counts as empty, with no bytes and no tokens; strings of special tokens
count as the library takes them by default; equal rows give equal rows; only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import in_lots
from .common import map_rows, table

VOCABULARY = "word_bpe_49k.json"
CHUNK, OVERLAP, LIMIT, MEMO = 16_384, 256, 2048, 400_000


# Fixed values of the vocabulary's file that the proof rests on.
SPLITS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
NORMALS = {"NFC", "Replace", "Lowercase"}


def has_proof(path: str) -> bool:
    """The vocabulary's normaliser and splitting pattern are those that the proof is for."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    steps = (held.get("normalizer") or {}).get("normalizers", [])
    split = (held.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    blanks = all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps if x["type"] == "Replace")
    return blanks and {x["type"] for x in steps} <= NORMALS and split.get("pattern", {}).get("Regex") in SPLITS and split.get("behavior") == "Removed"


def boundary(text: str, x: int, composed: bool) -> bool:
    """x is a proven boundary of the text. composed: the text is in normal form C."""
    a, b = text[x - 1], text[x]
    if a.isspace() or not composed or len(a.lower()) != 1 or len(b.lower()) != 1:
        return a.isspace()
    p, q = unicodedata.category(a)[0], unicodedata.category(b)[0]
    return "N" in (p, q) or (p == "L") != (q == "L") and not (q == "L" and a == "'")


class Counter:
    def __init__(self, path: str):
        self.proven = has_proof(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo: dict[str, int] = {}

    def starts(self, text: str) -> list[int]:
        """The character at which each token begins."""
        return [a for a, _ in self.library.encode(text, add_special_tokens=False).offsets]

    def short(self, texts: list[str]) -> list[int]:
        if not self.proven:
            return [len(x.ids) for x in self.library.encode_batch(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.memo) > MEMO:
            self.memo = {}
        new = list({w for words in split for w in words if w not in self.memo})
        for at in range(0, len(new), 512):  # one call for many words: a call costs more than a word
            part = new[at : at + 512]
            begins = np.cumsum([0, *(len(w) + 1 for w in part)])
            words = np.searchsorted(begins, self.starts(" ".join(part)), "right") - 1
            self.memo.update(zip(part, np.bincount(words, minlength=len(part)).tolist(), strict=True))
        return [sum(map(self.memo.__getitem__, words)) for words in split]

    def long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Splices chunk after chunk; `have` are the tokens before `begin`, a proven boundary (or 0)."""
        if overlap >= chunk:
            raise ValueError("chunks must be longer than their overlap")
        if not self.proven:
            return len(self.starts(text))
        composed = unicodedata.is_normalized("NFC", text)
        have = begin = 0
        end, step = min(chunk, len(text)), chunk
        left = self.starts(text[:end])
        while end < len(text):
            wide = overlap
            while True:
                at = max(begin, end - wide)
                stop = min(len(text), end - overlap + step)
                right = [at + x for x in self.starts(text[at:stop])]
                common = {x for x in left if x > at and boundary(text, x, composed)}.intersection(right)
                if common or at == begin:
                    break
                wide *= 2
            step = chunk if common else 2 * step
            if common:  # at == begin: the right chunk holds all of the left one
                begin = max(common)
                have += sum(x < begin for x in left)
            left, end = [x for x in right if x >= begin], stop
        return have + len(left)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(documents: DataFrame, vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        c = counter(path)
        for lot in in_lots((doc, t or "") for doc, t in it):
            short = iter(c.short([t for _, t in lot if len(t) <= chunk]))
            for doc, t in lot:
                yield doc, len(t.encode("utf-8", "replace")), next(short) if len(t) <= chunk else c.long(t, chunk, overlap)

    return map_rows(documents, ["doc_id", "text"], "doc_id long, n_bytes long, n_tokens long", rows)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
