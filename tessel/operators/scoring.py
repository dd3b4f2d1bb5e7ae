"""Passes over stemmed chunks in Arrow batches: terms, document frequencies, and bounded scores of many queries at once.

Rows are (collection, chunk_ord, stems); a task holds a batch of them, and what Scorer is given.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.text import STOP_WORDS, Stemmer

Batches = Iterator[pa.RecordBatch]
#: Bytes of stems that are worked on at once; rows passed on at once; cells of a block of scores; hits kept before they are judged again.
MOST_BYTES, ROWS, MOST_CELLS, MOST_KEPT = 4 << 20, 50_000, 1 << 20, 1 << 18
#: Room for rounding: of a bound, as a share, and of a score.
SHARE, SLACK = 1e-9, 1e-6
#: Terms of the matrix product and cells of the queries' side of it, and the share of cells that such a term fills; room for single precision, and the least score in it.
MOST_HEADS, HEAD_CELLS, HEAD_SHARE, LOOSE, TINY = 256, 1 << 22, 0.002, 5e-5, 1e-30
#: A block of which more than one cell in so many is kept raises its limit first.
MANY = 64


def stemmed(chunks: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """collection, chunk_ord, stems: the stems of each chunk's text, with single spaces between them."""
    words = STOP_WORDS if stop is None else stop

    def lines(batches: Batches) -> Batches:
        known = Stemmer(words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(known.line, b.column(2).to_pylist()), pa.string())], ["collection", "chunk_ord", "stems"])

    rows = chunks.select("collection", "chunk_ord", "text")
    return rows.mapInArrow(lines, f"collection string, chunk_ord {rows.schema['chunk_ord'].dataType.simpleString()}, stems string")


def lots(batches: Batches, most: int = MOST_BYTES) -> Iterator[pa.Table]:
    """Batches dealt anew: tables of one chunk a column, each of up to `most` bytes in the last column, or of one row."""
    held, size = [], 0

    def lot() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    for b in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(), dtype=np.int64), 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            upto = int(np.searchsorted(ends, base + most - size, side="right"))
            if upto <= at and held:
                yield lot()
                held, size = [], 0
                continue
            upto = max(upto, at + 1)
            held.append(b.slice(at, upto - at))
            size, at = size + ends[upto - 1] - base, upto
    if held:
        yield lot()


def by_collection(lot: pa.Table) -> Iterator[tuple[str, np.ndarray]]:
    """Each collection of a lot and the places of its lines that have a term. The first column is the collection, `stems` has the lines."""
    names = lot.column(0).chunk(0).dictionary_encode()
    code, filled = names.indices.to_numpy(zero_copy_only=False), pc.fill_null(pc.greater(pc.binary_length(lot["stems"].chunk(0)), 0), False).to_numpy(zero_copy_only=False)
    for k, name in enumerate(names.dictionary.to_pylist()):
        own = np.flatnonzero((code == k) & filled)
        if len(own):
            yield name, own


def occurring(lines: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """words, row, key, tf: the distinct words of some lines (none null or empty), and the terms of each line by row and key.

    The key of a term: its word's number, and for two in a row also 1 + the first one's, times the number of words.
    """
    parts = pc.split_pattern(lines, " ")
    flat = parts.flatten().dictionary_encode()
    ids, n = flat.indices.to_numpy().astype(np.int64), len(flat.dictionary)
    row = np.repeat(np.arange(len(lines)), pc.list_value_length(parts).to_numpy())
    pair = np.flatnonzero(row[1:] == row[:-1])
    key, width = np.concatenate([ids, n * (1 + ids[pair]) + ids[pair + 1]]), n * (n + 1)
    cell, tf = np.unique(np.concatenate([row, row[pair]]) * width + key, return_counts=True)
    row = cell // width
    return flat.dictionary, row, cell - row * width, tf


def named(words: pa.Array, key: np.ndarray) -> pa.Array:
    """The terms of keys that occurring() gave."""
    first, second = np.divmod(key, len(words))
    heads = words.take(pa.array(first - 1, mask=first == 0))
    return pc.binary_join_element_wise(heads, words.take(pa.array(second)), " ", null_handling="skip")


class Known:
    """Numbers of known terms: their places in a list."""

    def __init__(self, terms: pa.Array | list[str]):
        terms = terms if isinstance(terms, pa.Array) else pa.array(terms, pa.string())
        parts = pc.split_pattern(terms, " ")
        flat = parts.flatten().dictionary_encode()
        self.words, ids, many = flat.dictionary, flat.indices.to_numpy().astype(np.int64), pc.list_value_length(parts).to_numpy().astype(np.int64)
        last = np.cumsum(many) - 1
        code = len(self.words) * np.where(many == 2, 1 + ids[last - many + 1], 0) + ids[last]
        self.order = np.argsort(code)
        self.codes = code[self.order]

    def find(self, words: pa.Array, key: np.ndarray) -> np.ndarray:
        """The number of each term, given by its key; -1 for one that isn't known."""
        if not len(self.codes):
            return np.full(len(key), -1)
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        first, second = np.divmod(key, len(words))
        head, tail = np.concatenate([[0], 1 + place])[first], place[second]
        number = np.full(len(key), -1)
        on = np.flatnonzero((tail >= 0) & ((head > 0) | (first == 0)))
        code = len(self.words) * head[on] + tail[on]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        met = self.codes[at] == code
        number[on[met]] = self.order[at[met]]
        return number


def counted(stems: DataFrame) -> DataFrame:
    """collection, term, df: chunks that have a term, counted for a lot of a task's rows at a time; the caller adds them up."""

    def counts(batches: Batches) -> Batches:
        for lot in lots(batches):
            for name, own in by_collection(lot):
                words, _, key, _ = occurring(lot["stems"].chunk(0).take(pa.array(own)))
                key, df = np.unique(key, return_counts=True)
                for at in range(0, len(key), ROWS):
                    part = named(words, key[at : at + ROWS])
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(part)), part, pa.array(df[at : at + ROWS])], ["collection", "term", "df"])

    return stems.select("collection", "stems").mapInArrow(counts, "collection string, term string, df long")


def placed(stems: DataFrame) -> DataFrame:
    """collection, chunk_ord, term, tf."""

    def terms(batches: Batches) -> Batches:
        for lot in lots(batches):
            for name, own in by_collection(lot):
                words, row, key, tf = occurring(lot["stems"].chunk(0).take(pa.array(own)))
                for at in range(0, len(key), ROWS):
                    s = slice(at, at + ROWS)
                    part = named(words, key[s])
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(part)), lot["chunk_ord"].chunk(0).take(pa.array(own[row[s]])), part, pa.array(tf[s])], ["collection", "chunk_ord", "term", "tf"])

    return stems.select("collection", "chunk_ord", "stems").mapInArrow(terms, f"collection string, chunk_ord {stems.schema['chunk_ord'].dataType.simpleString()}, term string, tf long")


def set_places(flags: np.ndarray) -> np.ndarray:
    """np.flatnonzero() of flags of which few are set: eight are looked at together."""
    whole = len(flags) // 8 * 8
    eights = flags[:whole].reshape(-1, 8)
    some = np.flatnonzero(eights.view(np.uint64))
    r, c = np.nonzero(eights[some])
    return np.concatenate([some[r] * 8 + c, whole + np.flatnonzero(flags[whole:])])


class Scorer:
    """Scores of the chunks of one collection under all queries.

    known, idf: terms whose idf is held, all queries' terms among them; other terms' lies between `least` and
    `most`. number, query, weight: postings of the queries, as places in known and numbers of queries.

    Terms that many chunks and many queries have are the columns of a matrix product in single precision, the
    others are met by their postings. Products of the few hits that are kept are worked out again in doubles.
    """

    def __init__(self, known: pa.Array | list[str], idf: np.ndarray, least: float, most: float, number: np.ndarray, query: np.ndarray, weight: np.ndarray, k: int):
        self.known = Known(known)
        self.low, self.high = np.append(idf, least), np.append(idf, most)  # a term that isn't known has the number -1, which is the last place
        self.queries, query = np.unique(query, return_inverse=True)  # queries that meet no term here take no column
        self.n_queries = n_queries = len(self.queries)
        # shares of chunks (by the idf) and of queries that have a term: their product is that of the cells which it fills
        filled = np.exp(1 - idf) * np.bincount(number, minlength=len(idf)) / max(1, n_queries)
        heads = np.argsort(-filled, kind="stable")[: min(MOST_HEADS, HEAD_CELLS // max(1, n_queries))]
        heads = heads[filled[heads] >= HEAD_SHARE]
        self.head = np.full(len(idf) + 1, -1)
        self.head[heads] = np.arange(len(heads))
        on = self.head[number] >= 0
        self.heads = np.zeros((n_queries, len(heads)))
        np.add.at(self.heads, (query[on], self.head[number[on]]), weight[on])
        self.heads_32 = np.ascontiguousarray(self.heads.T, np.float32)
        number, query, weight = number[~on], query[~on], weight[~on]
        order = np.argsort(number, kind="stable")
        self.query, self.weight = query[order], weight[order]
        self.start = np.searchsorted(number[order], np.arange(len(idf) + 1))
        self.many = np.append(np.diff(self.start), 0)
        self.best, self.worst = np.zeros((k, n_queries)), np.zeros(n_queries)
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.n_kept, self.most_kept = 0, max(MOST_KEPT, 16 * k * n_queries)

    def add(self, lines: pa.Array | list[str], chunk: np.ndarray, block: int = 1024) -> None:
        """Takes the lines in, a block at a time: what can still be among the k best is kept. chunk: a number for each line, for the caller."""
        words, row, key, tf = occurring(lines if isinstance(lines, pa.Array) else pa.array(lines, pa.string()))
        number, step = self.known.find(words, key), max(1, min(block, MOST_CELLS // self.n_queries))
        for at in range(0, len(lines), step):
            n = min(step, len(lines) - at)
            s = slice(*np.searchsorted(row, [at, at + n]))
            self._block(row[s] - at, number[s], tf[s], chunk[at : at + n])

    def _block(self, row: np.ndarray, number: np.ndarray, tf: np.ndarray, chunk: np.ndarray) -> None:
        n = len(chunk)
        length = lambda idf: np.sqrt(np.maximum(np.bincount(row, (tf * idf[number]) ** 2, n), 1e-300))
        short, long = length(self.low), length(self.high)
        value = tf * self.low[number] / short[row]  # products with these are the greatest that scores can be

        at = np.flatnonzero(self.many[number])
        begin, many = self.start[number[at]], self.many[number[at]]
        posting = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        place, part = np.repeat(row[at] * self.n_queries, many) + self.query[posting], np.repeat(value[at], many) * self.weight[posting]
        at = np.flatnonzero(self.head[number] >= 0)
        front = np.zeros((n, self.heads.shape[1]))
        front[row[at], self.head[number[at]]] = value[at]
        most = front.astype(np.float32) @ self.heads_32
        np.add.at(most.ravel(), place, part.astype(np.float32))

        floor = np.maximum(self.limit() - LOOSE, TINY).astype(np.float32)
        met = most >= floor
        if np.count_nonzero(met) * MANY > met.size:  # the block's own k best raise the limit
            raised = np.concatenate([self.best.astype(np.float32), most * (short / long).astype(np.float32)[:, None]])
            met &= most >= np.partition(raised, n, axis=0)[n:].min(axis=0) - 2 * LOOSE
        cell, on = set_places(met.ravel()), met.ravel()[place]
        tail = np.bincount(np.searchsorted(cell, place[on]), part[on], len(cell))
        r, q = np.divmod(cell, self.n_queries)
        for x in (slice(at, at + ROWS) for at in range(0, len(cell), ROWS)):
            self._keep(chunk, r[x], q[x], (tail[x] + np.einsum("ij,ij->i", front[r[x]], self.heads[q[x]])) * short[r[x]], short, long)

    def _keep(self, chunk: np.ndarray, r: np.ndarray, q: np.ndarray, dot: np.ndarray, short: np.ndarray, long: np.ndarray) -> None:
        least, most, k = dot / long[r], dot / short[r], len(self.best)
        at = np.flatnonzero(least > self.worst[q])
        at = at[np.lexsort((-least[at], q[at]))]
        own, first, place = np.unique(q[at], return_index=True, return_inverse=True)
        rank = np.arange(len(at)) - first[place]
        at, place, rank = at[rank < k], place[rank < k], rank[rank < k]
        new = np.zeros((k, len(own)))
        new[rank, place] = least[at]
        self.best[:, own] = new = np.partition(np.concatenate([self.best[:, own], new]), k, axis=0)[k:]
        self.worst[own] = new.min(axis=0)
        on = (dot > 0) & (most >= self.limit()[q])
        self.kept.append((chunk[r[on]], q[on], dot[on], least[on], most[on]))
        self.n_kept += np.count_nonzero(on)
        if self.n_kept > self.most_kept:
            self.n_kept = len(self.left()[0])

    def raised(self, query: np.ndarray, least: np.ndarray) -> None:
        """Takes in that k other chunks are above `least` under these queries."""
        at = np.searchsorted(self.queries, query)
        self.best[:, at] = self.worst[at] = least

    def limit(self) -> np.ndarray:
        return self.worst * (1 - SHARE) - SLACK

    def left(self) -> tuple[np.ndarray, ...]:
        """chunk, query, dot product, least and greatest score of what is still kept."""
        chunk, q, dot, least, most = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        on = most >= self.limit()[q]
        self.kept = [tuple(x[on] for x in (chunk, q, dot, least, most))]
        return self.kept[0]


def bounded(stems: DataFrame, scorers: Callable[[], dict[str, Scorer]], query_ids: pa.Array, query_type: str, block: int) -> DataFrame:
    """query_id, collection, chunk_ord, dot, least, most: of each task, the chunks that can be among the k best, with bounds of their scores."""
    names = ["query_id", "collection", "chunk_ord", "dot", "least", "most"]

    def scores(batches: Batches) -> Batches:
        spaces = scorers()
        # each kept hit needs its chunk's key, which may be of any type: keys of kept chunks alone are held
        keys: dict[str, list[pa.Array]] = defaultdict(list)
        ends: dict[str, int] = defaultdict(int)
        for lot in lots(batches):
            for name, own in by_collection(lot):
                if name in spaces:
                    spaces[name].add(lot["stems"].chunk(0).take(pa.array(own)), ends[name] + np.arange(len(own)), block)
                    keys[name].append(lot["chunk_ord"].chunk(0).take(pa.array(own)))
                    ends[name] += len(own)
        for name, space in spaces.items():
            if space.kept:
                chunk, q, dot, least, most = space.left()
                held = pa.concat_arrays(keys[name])
                for at in range(0, len(q), 10_000):
                    s = slice(at, at + 10_000)
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(space.queries[q[s]])), pa.array([name] * len(q[s]), pa.string()), held.take(pa.array(chunk[s])), *(pa.array(x[s]) for x in (dot, least, most))], names)

    return stems.select("collection", "chunk_ord", "stems").mapInArrow(scores, f"query_id {query_type}, collection string, chunk_ord {stems.schema['chunk_ord'].dataType.simpleString()}, dot double, least double, most double")


def spaces_of(hot: pa.Table, asked: pa.Table, bounds: dict[str, tuple[float, float]], query_ids: pa.Array, k: int, limits: pa.Table | None = None) -> dict[str, Scorer]:
    """A Scorer for each collection that queries meet. hot: collection, term, idf; asked: query_id, collection, term, qw, idf; bounds: least and most idf of a term that neither has, by collection; limits: query_id, collection, least of which k other chunks are known to be above."""
    place, out = pc.index_in(asked["query_id"], value_set=query_ids), {}
    for name in pc.unique(asked["collection"]).to_pylist():
        mine = pc.equal(asked["collection"], name)
        own, query = asked.filter(mine), place.filter(mine).to_numpy().astype(np.int64)
        common = hot.filter(pc.equal(hot["collection"], name)).combine_chunks()
        terms = pc.unique(pa.chunked_array([*common["term"].chunks, *own["term"].chunks], pa.string()))
        idf, number = np.zeros(len(terms)), pc.index_in(own["term"], value_set=terms).to_numpy().astype(np.int64)
        idf[pc.index_in(common["term"], value_set=terms).to_numpy()] = common["idf"].to_numpy()
        idf[number] = own["idf"].to_numpy()
        out[name] = Scorer(terms, idf, *bounds[name], number, query, own["qw"].to_numpy(), k)
        if limits is not None:
            above = limits.filter(pc.equal(limits["collection"], name))
            out[name].raised(pc.index_in(above["query_id"], value_set=query_ids).to_numpy(), above["least"].to_numpy())
    return out


def weights(stems: DataFrame, common: Callable[[], pa.Table], once: dict[str, float]) -> DataFrame:
    """collection, chunk_ord, term, weight: tf * idf, each chunk of length 1. stems: with `rare`, its terms' (term, idf) where common hasn't the term and other chunks have it; once: idf of a term of one chunk, by collection."""

    def weigh(batches: Batches) -> Batches:
        table, spaces = common(), {}
        for name, alone in once.items():
            own = table.filter(pc.equal(table["collection"], name)).combine_chunks()
            spaces[name] = Known(own["term"].to_pylist()), np.append(own["idf"].to_numpy(), alone)
        for lot in lots(batches):
            for name, own in by_collection(lot):
                (known, idf), at = spaces[name], pa.array(own)
                words, row, key, tf = occurring(lot["stems"].chunk(0).take(at))
                idf = idf[known.find(words, key)]
                rare = lot["rare"].chunk(0).take(at)
                many, held = pc.fill_null(pc.list_value_length(rare), 0).to_numpy(), rare.flatten()
                if len(held):  # their keys among the lines', which are in order
                    term, width = Known(held.field("term")), len(words) * (len(words) + 1)
                    place = pc.index_in(term.words, value_set=words).to_numpy().astype(np.int64)
                    head, tail = np.divmod(term.codes, len(term.words))
                    code = len(words) * np.where(head > 0, 1 + place[head - 1], 0) + place[tail]
                    idf[np.searchsorted(row * width + key, np.repeat(np.arange(len(many)), many)[term.order] * width + code)] = held.field("idf").to_numpy()[term.order]
                w = tf * idf
                w /= np.sqrt(np.bincount(row, w * w, len(own)))[row]
                for s in (slice(x, x + ROWS) for x in range(0, len(key), ROWS)):
                    part = named(words, key[s])
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(part)), lot["chunk_ord"].chunk(0).take(pa.array(own[row[s]])), part, pa.array(w[s])], ["collection", "chunk_ord", "term", "weight"])

    return stems.select("collection", "chunk_ord", "rare", "stems").mapInArrow(weigh, f"collection string, chunk_ord {stems.schema['chunk_ord'].dataType.simpleString()}, term string, weight double")
