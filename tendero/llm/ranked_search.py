"""Ranked lexical search: posting lists with range-maximum tables, searched best first.

The index is a stored table of blocks. A block holds some thousand documents in ascending id
order: their term counts, the hashes of their different terms in order, and for each term a
posting list (place in the block, occurrences). A search loads the lists of the asked terms,
turns occurrences into impacts, and builds a sparse table of range maxima over each list.

A query starts with the whole block as one interval. The maxima of its lists over an interval
add up to a bound of every score in it. The interval with the highest bound comes first: it is
split at the document of the greatest single impact, whose score is settled, or scored as a
whole once it holds few postings. Intervals whose bound doesn't reach the k-th best result
so far are never opened; a task carries its results from block to block.

Terms are maximal runs of ``[0-9A-Za-z]`` and of characters from 128, A-Z lowered, known by a
64-bit hash. Scores follow the stated integers: ``w * ((10^9 tf) div (1000 tf + 8 m))``.

Rows: null texts have no term and no part in any count; every row is a document of its own, so
an id may come twice; null ids come first among equals. Equal (item, text) rows of the queries count
once, different texts of one item id add up; items without a hit have no row. Long texts are
taken whole. Queries are sent to the tasks in groups of at most ``QUERY_TERMS`` terms.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tendero.llm import words as W
from tendero.session import stored

BLOCK_BYTES = 16_000_000  # bytes of text of an index block
LEAF = 8192  # postings of an interval that is scored as a whole
QUERY_TERMS = 2_000_000  # different (item, term) pairs sent to every task at a time: 32 MB
NULL_ID = -(1 << 63)

# Bytes outside terms become blanks, A-Z become a-z.
_PLAIN = np.full(256, 0x20, np.uint8)
for _span in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _PLAIN[_span[0]:_span[1]] = np.arange(*_span)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)

INDEX = ("doc_ids binary, lengths binary, terms binary, starts binary, places binary, counts binary, "
         "documents long, all_terms long")


def term_hashes(column: pa.Array):
    """(first row, hashes, edges) of slices of a text column: every text's terms in order."""
    for at, _, data, offsets in W.slices(column):
        data = _PLAIN[data]
        starts, ends, bounds = W.word_spans(data, offsets)
        yield at, W.word_hashes(data, starts, ends), bounds


# --- index ---------------------------------------------------------------------------

def _block(ids: list[np.ndarray], hashes: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
    ids, hashes, sizes = np.concatenate(ids), np.concatenate(hashes), np.concatenate(sizes)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    terms, code = np.unique(hashes, return_inverse=True)
    cell, counts = np.unique(code * len(ids) + np.repeat(place, sizes), return_counts=True)
    starts = np.searchsorted(cell, np.arange(len(terms) + 1) * len(ids))
    columns = [ids[order], sizes[order].astype(np.int32), terms, starts.astype(np.int32),
               (cell % len(ids)).astype(np.int32), counts.astype(np.int32)]
    return pa.RecordBatch.from_arrays(
        [pa.array([x.tobytes()], pa.binary()) for x in columns] + [pa.array([len(ids)]), pa.array([int(sizes.sum())])],
        ["doc_ids", "lengths", "terms", "starts", "places", "counts", "documents", "all_terms"])


def _blocks(limit: int):
    def run(batches):
        held, kept = 0, ([], [], [])
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy()
            for at, hashes, edges in term_hashes(batch.column(1)):
                size = np.diff(edges)
                some = size > 0
                if not some.any():
                    continue
                for part, x in zip(kept, (ids[at:at + len(size)][some], hashes, size[some])):
                    part.append(x)
                held += len(hashes) * 6  # bytes of text, about
                if held >= limit:
                    yield _block(*kept)
                    held, kept = 0, ([], [], [])
        if held:
            yield _block(*kept)
    return run


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index of all texts, one row per block, stored in the shared folder."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(texts.mapInArrow(_blocks(block_bytes), INDEX), "postings")


# --- search --------------------------------------------------------------------------

def _query_terms(batches):
    for batch in batches:
        for at, hashes, edges in term_hashes(batch.column(1)):
            items = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(edges) - 1).take(pa.array(items)),
                                              pa.array(hashes.view(np.int64))], ["item_id", "term"])


def _frequencies(asked: np.ndarray):
    """Documents of each asked term in the blocks of a task."""
    def run(batches):
        df = np.zeros(len(asked), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1)):
                terms, starts = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(starts.as_buffer(), np.int32)
                at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
                hit = terms[at] == asked
                df[hit] += np.diff(starts)[at[hit]]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])
    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Lists:
    """Impacts of the asked terms' posting lists in one block, with their range maxima."""

    def __init__(self, row: dict, asked: np.ndarray, documents: int, all_terms: int):
        part = {k: np.frombuffer(row[k], t) for k, t in (("doc_ids", np.int64), ("lengths", np.int32), ("terms", np.uint64),
                                                         ("starts", np.int32), ("places", np.int32), ("counts", np.int32))}
        self.ids = part["doc_ids"]
        at = np.minimum(np.searchsorted(part["terms"], asked), len(part["terms"]) - 1)
        held = part["terms"][at] == asked
        size = np.where(held, np.diff(part["starts"])[at], 0).astype(np.int64)
        take = W.ranges(part["starts"][at].astype(np.int64), size)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.places = part["places"][take]
        tf = part["counts"][take].astype(np.int64)
        m = 100 - 75 + (75 * part["lengths"].astype(np.int64) * documents) // all_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.places])
        self.table = [impact.astype(np.int32)]
        # level j holds the greatest of 2^j impacts from each place on; lists are read inside their ends only
        for j in range(int(size.max(initial=1)).bit_length() - 1):
            low = self.table[-1]
            high = low.copy()
            if 1 << j < len(low):
                np.maximum(low[:-(1 << j)], low[1 << j:], out=high[:-(1 << j)])
            self.table.append(high)
        self.table = np.stack(self.table)
        # one sorted array of (list, place) for searching several lists at once
        self.keys = np.repeat(np.arange(len(asked)), size) * (len(self.ids) + 1) + self.places

    def maxima(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Greatest impact of each stretch [a, b); 0 for an empty one."""
        some = b > a
        level = np.frexp(np.maximum(b - a, 1).astype(np.float64))[1] - 1
        last = max(self.table.shape[1] - 1, 0)
        left = self.table[level, np.minimum(a, last)]
        return np.where(some, np.maximum(left, self.table[level, np.clip(b - (1 << level), 0, last)]), 0).astype(np.int64)


class Best:
    """The k best (score, id) so far: higher scores first, then lower ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            near = scores >= self.scores[-1]
            scores, ids = scores[near], ids[near]
        near = scores > 0
        if near.any():
            s, i = np.concatenate((self.scores, scores[near])), np.concatenate((self.ids, ids[near]))
            if len(s) > 8 * self.k:  # by score first; ties with the k-th stay in
                s, i = (x[s >= np.partition(s, len(s) - self.k)[len(s) - self.k]] for x in (s, i))
            order = np.lexsort((i, -s))[:self.k]
            self.scores, self.ids = s[order], i[order]

    def open(self, bound: int, least_id: int) -> bool:
        """Whether an interval with this bound and lowest id can still change the result."""
        if len(self.scores) < self.k:
            return bound > 0
        return bound > self.scores[-1] or (bound == self.scores[-1] and least_id < self.ids[-1])


def search_block(lists: Lists, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Adds the block's documents that belong to the best of a query; ``terms`` number the asked lists."""
    held = lists.ends[terms] > lists.starts[terms]
    terms, weights = terms[held], weights[held]
    if not len(terms):
        return
    stride = len(lists.ids) + 1
    exact = float(weights.sum()) * 1e6 < 2 ** 53  # sums of doubles are whole up to there

    def entry(lo: int, hi: int, a: np.ndarray, b: np.ndarray) -> None:
        some = b > a
        if some.any():
            top = weights * lists.maxima(a, b)
            bound = int(top.sum())
            if best.open(bound, lists.ids[lo]):
                heapq.heappush(heap, (-bound, lo, hi, a, b, int(top.argmax())))

    heap: list = []
    entry(0, len(lists.ids), lists.starts[terms], lists.ends[terms])
    while heap:
        bound, lo, hi, a, b, heaviest = heapq.heappop(heap)
        if not best.open(-bound, lists.ids[lo]):
            if len(best.scores) == best.k and -bound < best.scores[-1]:
                break
            continue
        size = b - a
        if size.sum() <= LEAF or hi - lo == 1:
            take = W.ranges(a, size)
            gain, place = np.repeat(weights, size) * lists.table[0, take], lists.places[take] - lo
            if exact:
                scores = np.bincount(place, gain, hi - lo).astype(np.int64)
            else:
                scores = np.zeros(hi - lo, np.int64)
                np.add.at(scores, place, gain)
            best.add(scores, lists.ids[lo:hi])
            continue
        at = a[heaviest] + int(lists.table[0, a[heaviest]:b[heaviest]].argmax())
        place = int(lists.places[at])
        # the same document in every list of the query
        cut = np.clip(np.searchsorted(lists.keys, terms * stride + place), a, b)
        here = (cut < b) & (lists.places[np.minimum(cut, len(lists.places) - 1)] == place)
        score = int((weights[here] * lists.table[0, cut[here]]).sum())
        best.add(np.array([score]), lists.ids[place:place + 1])
        entry(lo, place, a, cut)
        entry(place + 1, hi, cut + here, b)


def _searched(asked, weights, items, edges, codes, repeats, documents: int, all_terms: int, k: int):
    """Best documents of every item among the blocks of a task."""
    def run(batches):
        found = [Best(k) for _ in items]
        for batch in batches:
            for n in range(batch.num_rows):
                lists = Lists({name: batch.column(name)[n].as_buffer() for name in batch.schema.names}, asked, documents, all_terms)
                for q, best in enumerate(found):
                    mine = slice(edges[q], edges[q + 1])
                    search_block(lists, codes[mine], weights[codes[mine]] * repeats[mine], best)
        some = [q for q, best in enumerate(found) if len(best.ids)]
        if some:
            ids = np.concatenate([found[q].ids for q in some])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for q in some for x in [items[q]] * len(found[q].ids)], pa.int64()), pa.array(ids, mask=ids == NULL_ID),
                 pa.array(np.concatenate([found[q].scores for q in some]))], ["item_id", "doc_id", "score"])
    return run


def search(index: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "item_id", text_col: str = "text",
           most_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of each query."""
    spark = index.sparkSession
    size = index.agg(F.sum("documents").alias("n"), F.sum("all_terms").alias("l")).first()
    terms = (queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
             .mapInArrow(_query_terms, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("n")))
    terms = stored(terms, "asked")
    groups = -(-terms.count() // most_terms)
    result = "item_id long, doc_id long, score long"
    hits = spark.createDataFrame([], result)
    for g in range(groups if size["n"] else 0):
        mine = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).orderBy("item_id", "term").toArrow()
        ids = mine["item_id"].combine_chunks()
        # null item ids are one item like any other
        items = ids.unique().to_pylist()
        edges = np.searchsorted(ids.dictionary_encode(null_encoding="encode").indices.to_numpy(), np.arange(len(items) + 1))
        asked, codes = np.unique(mine["term"].to_numpy().view(np.uint64), return_inverse=True)
        held = (index.select("terms", "starts").mapInArrow(_frequencies(asked), "term long, df long")
                .groupBy("term").agg(F.sum("df").alias("df")).toPandas())
        weights = np.zeros(len(asked), np.int64)
        weights[held["term"]] = [weight(size["n"], df) for df in held["df"].tolist()]
        repeats = mine["n"].to_numpy()
        # a term that every document holds weighs nothing
        some = weights[codes] > 0
        edges = np.concatenate(([0], np.cumsum(some)))[edges]
        hits = hits.union(index.drop("documents", "all_terms").mapInArrow(
            _searched(asked, weights, items, edges, codes[some], repeats[some], size["n"], size["l"], k), result))
    place = Wd.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
    WITH words AS (
      SELECT doc_id, n, unnest(found) AS term FROM (
        SELECT doc_id, found, len(found) AS n FROM (
          SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents WHERE text IS NOT NULL)
        WHERE len(found) > 0)),
    totals AS (SELECT count(DISTINCT doc_id) AS all_docs, count(*) AS all_terms FROM words),
    postings AS (SELECT doc_id, n, term, count(*) AS tf FROM words GROUP BY doc_id, n, term),
    weights AS (
      SELECT term, CAST(floor(1000 * ln((2.0 * all_docs + 2.0) / (2.0 * count(*) + 1.0))) AS BIGINT) AS w
      FROM postings, totals GROUP BY term, all_docs),
    asked AS (
      SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
      GROUP BY item_id, term),
    scored AS (
      SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms)))) AS BIGINT) AS score
      FROM asked JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY item_id, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    WHERE rank <= 10"""
