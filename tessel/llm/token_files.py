"""Token ids as Arrow files of equal-length sequences, for random access without copies.

Documents are sorted by id over range partitions, and each task writes its range as one file: the
documents' ids one after the other, each with END, cut into sequences of `length`. A file is in Arrow's
file format (batches and a footer with their places); its columns are fixed-size lists, `ids`
(unsigned, of 16 bits where the vocabulary allows, else 32) and `mask` (true for ids, false for the
padding of the file's last sequence). A reader maps the file, finds the batch of a sequence by
division and views its numbers where they lie. Beside it stands a file of the documents (doc_id, n_tokens), in
the same order. The table of files, written by Spark, names only those of tasks that succeeded; what
failed or rival attempts left has other names and is never read. A file's first id has the place that
the files before it leave, a running sum over the table of files alone.

Encoding keeps what it has met, word by word, where the vocabulary's file allows that (see token_counts),
and takes whole texts otherwise.

Defined results: null text counts as empty and gives END alone; rows of equal id are documents each,
ordered by their text; null ids come first; no documents give no files and no rows; only
doc_id and text are read.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import in_lots
from .common import map_rows, shared_dir, table, written
from .token_counts import VOCABULARY, Counter

LENGTH, END, SEQUENCES_A_BATCH, MEMO = 2048, 2, 64, 300_000
LOT_CHARS, LOT_ROWS = 4 << 20, 4096
FILES = "part int, path string, docs_path string, n_docs long, n_tokens long"


# Letters of which each is in normal form C and has a lower case of one character, and signs but the apostrophe.
_LETTER, _SIGN = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
#: One match of the splitting pattern.
MATCH = re.compile(f"[{_LETTER}]+|[{_SIGN}]+")


def is_plain(text: str) -> bool:
    """Latin-1, where ASCII letters may be put in lower case before the normaliser does it, and without a beginning of a special token."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


class Encoder(Counter):
    """Ids of texts, without special tokens of the library's own adding.

    Where the vocabulary's file allows it, a lot of plain texts is cut into words by Arrow: at spaces and
    line ends, and between a letter and a sign, where the pattern parts them anyway. Each distinct word of
    the lot is looked up once, new ones go to the library, many in a call, and numpy puts the ids of the
    words in their places. Ids are kept by word; when MEMO words are held, they become the older half of
    the memory, and words that come again move to the newer one; so frequent words stay. Other texts are
    cut at spaces and line ends alone.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.kind = np.uint16 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        for token, at in self.library.get_vocab().items() if suffix else ():
            self.ends[at] = token.endswith(suffix)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.proven:
            return [np.array(x.ids, self.kind) for x in self.library.encode_batch(texts, add_special_tokens=False)]
        plain = np.array([is_plain(t) for t in texts], bool)
        found: list[np.ndarray] = [None] * len(texts)
        for flag in (True, False):
            at = np.flatnonzero(plain == flag)
            for k, ids in zip(at.tolist(), self.cut([texts[k] for k in at], flag) if len(at) else (), strict=True):
                found[k] = ids
        return found

    def cut(self, texts: list[str], plain: bool) -> list[np.ndarray]:
        column = pa.array(texts, pa.large_string())
        if plain:
            column = pc.replace_substring_regex(pc.ascii_lower(column), f"([{_LETTER}])([{_SIGN}])", r"\1 \2")
        parts = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = pc.dictionary_encode(pc.list_flatten(parts))
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.words) > MEMO:
            self.older, self.words = self.words, {"": b""}
        self.learn({w for w in words if w not in self.words})
        ids = [self.words[w] for w in words]
        size = np.array(list(map(len, ids)), np.int64) // np.dtype(self.kind).itemsize
        pool, start = np.frombuffer(b"".join(ids), self.kind), np.cumsum(size) - size
        n = size[code]
        end = np.cumsum(n)
        out = pool[np.repeat(start[code] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        bounds = np.concatenate([[0], end])[np.asarray(parts.offsets) - parts.offsets[0].as_py()]
        return [out[a:b] for a, b in itertools.pairwise(bounds.tolist())]

    def learn(self, new: set[str]) -> None:
        """Keeps the ids of words that the memory lacks."""
        again = self.older.keys() & new
        self.words.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new = new - again
        single = [w for w in new if MATCH.fullmatch(w)]
        self.words.update(self.of_matches(single))
        self.words.update(self.of_words(list(new.difference(single))))

    def of_matches(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of strings that are one match of the pattern each."""
        for at in range(0, len(new), 512):  # one call for many: a call costs more than a word
            part = new[at : at + 512]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                yield from ((w, ids[a:b].tobytes()) for w, a, b in zip(part, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True))
            else:
                yield from self.of_words(part)

    def of_words(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of any strings without spaces, told apart by the offsets of their tokens."""
        for at in range(0, len(new), 512):
            part = new[at : at + 512]
            got = self.library.encode(" ".join(part), add_special_tokens=False)
            begins = np.cumsum([0, *(len(w) + 1 for w in part)])
            cuts = np.searchsorted([a for a, _ in got.offsets], begins).tolist()
            ids = np.array(got.ids, self.kind)
            yield from ((w, ids[a:b].tobytes()) for w, a, b in zip(part, cuts[:-1], cuts[1:], strict=True))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the place in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def schema_of(kind: type, length: int) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.from_numpy_dtype(kind), length), False), pa.field("mask", pa.list_(pa.bool_(), length), False)], {b"length": str(length).encode()})


class SequenceFile:
    """Writes arrays of ids as one Arrow file of sequences; holds one batch at a time."""

    def __init__(self, path: str, kind: type, length: int):
        store, place = _store(path)
        self.length, self.schema, self.n, self.used = length, schema_of(kind, length), 0, 0
        self.sink = store.open_output_stream(place)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held = np.zeros(length * SEQUENCES_A_BATCH, kind)

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        while len(ids):
            part = ids[: len(self.held) - self.used]
            self.held[self.used : self.used + len(part)] = part
            self.used += len(part)
            ids = ids[len(part) :]
            if self.used == len(self.held):
                self._flush()

    def _flush(self) -> None:
        whole = -(-self.used // self.length) * self.length
        mask = np.arange(whole) < self.used
        self.held[self.used : whole] = 0
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((self.held[:whole], mask), self.schema, strict=True)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.used = 0

    def close(self) -> None:
        if self.used:
            self._flush()
        self.file.close()
        self.sink.close()


class Sequences:
    """Random access to a file of sequences: mapped where it lies on a mounted file system."""

    def __init__(self, path: str):
        store, place = _store(path)
        self.source = pa.memory_map(place) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(place)
        self.file = pa.ipc.open_file(self.source)
        self.length = int(self.file.schema.metadata[b"length"])

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return n and (n - 1) * SEQUENCES_A_BATCH + self.file.get_batch(n - 1).num_rows

    def _column(self, batch: int, name: str) -> pa.Array:
        c = self.file.get_batch(batch).column(name)
        return c.values.slice(c.offset * self.length, len(c) * self.length)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """ids (a view) and mask (Arrow bits) of sequence i."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch, row = divmod(i, SEQUENCES_A_BATCH)
        return tuple(f(self._column(batch, c).slice(row * self.length, self.length)) for f, c in ((pa.Array.to_numpy, "ids"), (lambda x: x, "mask")))

    def span(self, start: int, n: int) -> list[np.ndarray]:
        """Views of n ids from place `start` on, one for each batch that they touch."""
        size, out = SEQUENCES_A_BATCH * self.length, []
        while n:
            batch, at = divmod(start, size)
            out.append(self._column(batch, "ids").slice(at, n).to_numpy())
            start, n = start + len(out[-1]), n - len(out[-1])
        return out

    def n_tokens(self) -> int:
        return sum(self._column(b, "mask").true_count for b in range(self.file.num_record_batches))

    def close(self) -> None:
        self.source.close()


def write_files(documents: DataFrame, folder: str, vocabulary: str | None = None, length: int = LENGTH, end: int = END, parts: int | None = None) -> DataFrame:
    """The table of files: part, path, docs_path, n_docs, n_tokens, start (place of the file's first id).

    parts: files at most; the session's number of shuffle partitions unless given.
    """
    parts = parts or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    store, place = _store(folder)
    store.create_dir(place, recursive=True)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        first = next(it, None)
        if first is None:
            return
        e, part = encoder(path), TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        file, n_docs = SequenceFile(f"{name}.arrow", e.kind, length), 0
        docs, docs_place = _store(f"{name}.docs.arrow")
        kinds = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        with docs.open_output_stream(docs_place) as sink, pa.ipc.new_file(sink, kinds) as listed:
            for lot in in_lots(((doc, t or "") for doc, t in itertools.chain([first], it)), LOT_CHARS, LOT_ROWS):
                found = e.encode([t for _, t in lot])
                for ids in found:
                    file.add(ids)
                    file.add(np.array([end], e.kind))
                listed.write_batch(pa.record_batch([pa.array([d for d, _ in lot], pa.int64()), pa.array([len(ids) + 1 for ids in found], pa.int64())], schema=kinds))
                n_docs += len(lot)
        file.close()
        yield part, f"{name}.arrow", f"{name}.docs.arrow", n_docs, file.n

    # ranges by id and a digest of the text: a repeated id is parted by its texts, and the order is the same each time
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    files = written(map_rows(ordered, ["doc_id", "text"], FILES, rows), "token-files")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    return files.withColumn("start", F.coalesce(before, F.lit(0)))


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; a file that its table contradicts is an error."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for path, docs_path, n_tokens, start in it:
            sequences, at = Sequences(path), 0
            if sequences.n_tokens() != n_tokens:
                raise ValueError(f"{path} has {sequences.n_tokens()} ids, not {n_tokens}")
            store, place = _store(docs_path)
            with store.open_input_file(place) as source, pa.ipc.open_file(source) as listed:
                for b in range(listed.num_record_batches):
                    for doc, n in zip(*(c.to_pylist() for c in listed.get_batch(b).columns), strict=True):
                        crc = 0
                        for view in sequences.span(at, n):
                            crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                        yield doc, start + at, n, crc
                        at += n
            sequences.close()

    # one file or a few to a task: they were written in equal ranges
    spread = files.repartition(max(files.sparkSession.sparkContext.defaultParallelism * 4, 1))
    return map_rows(spread, ["path", "docs_path", "n_tokens", "start"], "doc_id long, start long, n_tokens long, ids_crc32 long", rows)


def read_sequences(files: DataFrame) -> DataFrame:
    """sequence (from 0, in order of files), ids, mask: what a training job streams."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for path, first in it:
            sequences = Sequences(path)
            for i in range(len(sequences)):
                ids, mask = sequences[i]
                yield first + i, ids.tolist(), mask.to_pylist()
            sequences.close()

    def counted(it: Iterator[tuple]) -> Iterator[tuple]:
        for part, path in it:
            sequences = Sequences(path)
            yield part, path, len(sequences)
            sequences.close()

    n = map_rows(files, ["part", "path"], "part int, path string, n long", counted)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = n.withColumn("first", F.coalesce(before, F.lit(0)))
    return map_rows(placed, ["path", "first"], "sequence long, ids array<int>, mask array<boolean>", rows)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read_documents(write_files(table(spark, sf_dir, "documents"), folder))
