"""Benchmark decontamination: BM25 over test items, asked with every training passage.

Test items are the documents of an inverted index, cut into units of at most ``UNIT``
words; a unit's BM25 impacts are divided by the score it gives itself, so one
threshold fits short and long items. Every training text is cut into passages of
``2 * UNIT`` words that start every ``UNIT`` words (each unit lies whole in one of
them), and every passage is a query:

* words are looked up many texts at a time; lists of frequent words, which together can
  give no unit more than half the threshold, do not open a candidate; a passage whose
  other words cannot lift any unit to the threshold ends here (an upper bound);
* what is left runs block-max WAND, which returns all units above the threshold;
* a hit is confirmed on five-word shingles: the shares of the item's question and of its
  answer that stand in the passage must both reach ``overlap``.

The index of ``index_words`` words of items goes to all tasks; more items take further
passes over the texts, with the same statistics. Items have ``question`` and ``answer``
columns, or a ``text`` whose last quarter of words counts as the answer.

Words are compared without ASCII signs at their ends, and runs of signs alone are no words,
in texts and items alike: a passage is found whatever is glued to its words. ``first_word``
counts these words.

Rows: null and empty texts and items match nothing, nor do words of null ids differ from
others; items without a letter or digit match nothing; an item under five words must stand
whole; repeated rows each give their rows; equal items all match. Long texts are taken whole.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendero.llm import words as W

UNIT = 64
BLOCK = 32  # postings of a block with its own largest impact
K1, B = 1.2, 0.75
SIGN = np.zeros(256, bool)
SIGN[[x for x in range(0x21, 0x7F) if not chr(x).isalnum()]] = True
NOT_SIGN = r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def bare_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words without the signs at their ends, and the edges of each text."""
    starts, ends, bounds = W.word_spans(data, offsets)
    glued = np.flatnonzero(SIGN[data[starts]] | SIGN[data[ends - 1]])
    if len(glued):
        inner = np.flatnonzero(~(SIGN | W.SPACE)[data])
        a, b = np.searchsorted(inner, (starts[glued], ends[glued]))
        some = b > a
        starts[glued[some]], ends[glued[some]] = inner[a[some]], inner[b[some] - 1] + 1
        kept = np.ones(len(starts), bool)
        kept[glued[~some]] = False
        starts, ends = starts[kept], ends[kept]
        bounds = np.searchsorted(starts, offsets)
    return W.word_hashes(W.LOWER[data], starts, ends), bounds


def hashes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``bare_words`` of some texts."""
    return bare_words(*W.text_bytes(pa.array(texts, pa.string())))


@dataclass
class Index:
    """Impact-ordered bounds over postings in unit order; terms are positions in ``vocabulary``."""

    vocabulary: np.ndarray  # sorted word hashes
    starts: np.ndarray  # first posting of each term
    units: np.ndarray
    impacts: np.ndarray
    block_most: list  # per term the largest impact of each block
    most: np.ndarray  # per term
    item: np.ndarray  # item row of each unit
    rest: np.ndarray  # per unit, what its frequent words can add
    frequent: np.ndarray  # per term
    flags: np.ndarray
    item_ids: list
    parts: list  # per item: (question words, answer words)

    def terms(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that the index knows, and their terms."""
        at = np.flatnonzero(self.flags[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(self.vocabulary, hashes[at])
        place[place == len(self.vocabulary)] = 0
        known = self.vocabulary[place] == hashes[at]
        return at[known], place[known]

    def above(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (unit, score) of at least the threshold, by block-max WAND."""
        lists = []
        for t in terms:
            a, b = self.starts[t], self.starts[t + 1]
            lists.append([self.units[a:b].tolist(), self.impacts[a:b], self.block_most[t], float(self.most[t]), 0])
        found = []
        while True:
            lists = sorted((x for x in lists if x[4] < len(x[0])), key=lambda x: x[0][x[4]])
            bound, pivot = 0.0, None
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                return found
            unit = lists[pivot][0][lists[pivot][4]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == unit:
                pivot += 1
            head = lists[:pivot + 1]
            places = [bisect_left(x[0], unit, x[4]) for x in head]
            local = sum(x[2][p // BLOCK] for x, p in zip(head, places) if p < len(x[0]))
            if local < threshold - 1e-9:
                # no unit up to the end of these blocks can reach the threshold
                ends = [x[0][min((p // BLOCK + 1) * BLOCK, len(x[0])) - 1] for x, p in zip(head, places) if p < len(x[0])]
                after = min(ends) + 1
                if pivot + 1 < len(lists):
                    after = min(after, lists[pivot + 1][0][lists[pivot + 1][4]])
                after = max(after, unit + 1)
                for x in head:
                    x[4] = bisect_left(x[0], after, x[4])
                continue
            total = 0.0
            for x, p in zip(head, places):
                if p < len(x[0]) and x[0][p] == unit:
                    total += float(x[1][p])
                    p += 1
                x[4] = p
            if total >= threshold - 1e-9:
                found.append((unit, total))


def build_index(items: list[tuple], frequency: dict[int, int], count: int, mean: float, threshold: float) -> Index:
    """The index of (item_id, question, answer) rows; ``frequency``: units of all items that hold a word."""
    hashes, bounds = hashes_of([x for _, q, a in items for x in (q, a)])
    parts = [(hashes[bounds[2 * k]:bounds[2 * k + 1]], hashes[bounds[2 * k + 1]:bounds[2 * k + 2]]) for k in range(len(items))]
    rows, item = [], []
    for k, (q, a) in enumerate(parts):
        whole = np.concatenate((q, a))
        for at in range(0, len(whole), UNIT):
            words, tf = np.unique(whole[at:at + UNIT], return_counts=True)
            df = np.array([frequency[int(w)] for w in words], float)
            weight = np.log(1 + (count - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (
                tf + K1 * (1 - B + B * min(UNIT, len(whole) - at) / mean))
            rows.append((words, weight / weight.sum()))
            item.append(k)
    unit = np.repeat(np.arange(len(rows)), [len(w) for w, _ in rows])
    word, impact = np.concatenate([w for w, _ in rows]), np.concatenate([x for _, x in rows])
    order = np.lexsort((unit, word))
    unit, word, impact = unit[order], word[order], impact[order]
    vocabulary, starts = np.unique(word, return_index=True)
    starts = np.append(starts, len(word))
    most = np.maximum.reduceat(impact, starts[:-1])
    blocks = [[float(impact[p:min(p + BLOCK, b)].max()) for p in range(a, b, BLOCK)] for a, b in zip(starts[:-1], starts[1:])]
    # the longest lists, as long as no unit gets over half the threshold from them
    rest, frequent = np.zeros(len(rows)), np.zeros(len(vocabulary), bool)
    for t in np.argsort(-np.diff(starts), kind="stable"):
        at = slice(starts[t], starts[t + 1])
        if (rest[unit[at]] + impact[at]).max() > threshold / 2:
            break
        rest[unit[at]] += impact[at]
        frequent[t] = True
    flags = np.zeros(1 << 20, bool)
    flags[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    return Index(vocabulary, starts, unit, impact, blocks, most, np.array(item), rest, frequent, flags,
                 [i for i, _, _ in items], parts)


def _share(part: np.ndarray, known: set) -> float:
    """Share of a part's shingles (five words, fewer if the part is shorter) that are known."""
    runs, _ = W.shingles(part, np.array([0, len(part)]), min(5, len(part)) or 1)
    return sum(x in known for x in runs.tolist()) / len(runs) if len(runs) else 1.0  # nothing is asked for


def _passages(index: Index, threshold: float, overlap: float):
    lengths = np.diff(index.starts)
    longest = max(len(q) + len(a) for q, a in index.parts)

    def candidates(hashes, bounds):
        """(text, passage, terms) of passages that may hold a unit above the threshold."""
        at, term = index.terms(hashes)
        text = np.searchsorted(bounds, at, "right") - 1
        place = (at - bounds[text]) // UNIT
        # passages are numbered through: passage p of a text covers its words p * UNIT up to (p + 2) * UNIT
        base = np.concatenate(([0], np.cumsum(np.diff(bounds) // UNIT + 2)))
        passage = np.concatenate((base[text] + place + 1, base[text] + place))  # shifted by one: place - 1 exists
        term, where = np.concatenate((term, term)), None
        rare = ~index.frequent[term]
        p, t = passage[rare], term[rare]
        n = lengths[t]
        posting = W.ranges(index.starts[t], n)
        key = np.repeat(p, n) * len(index.rest) + index.units[posting]
        keys, inverse = np.unique(key, return_inverse=True)
        sums = np.bincount(inverse, index.impacts[posting], len(keys))
        good = sums + index.rest[keys % len(index.rest)] >= threshold - 1e-9
        wanted = np.unique(keys[good] // len(index.rest))
        order = np.argsort(passage, kind="stable")
        passage, term = passage[order], term[order]
        for w in wanted.tolist():
            a, b = np.searchsorted(passage, (w, w + 1))
            owner = int(np.searchsorted(base, w, "right")) - 1
            yield owner, w - int(base[owner]) - 1, np.unique(term[a:b]).tolist()
        del where

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, _, data, offsets in W.slices(batch.column(1), W.SMALL_BYTES):
                hashes, bounds = bare_words(data, offsets)
                best: dict[tuple[int, int], tuple] = {}
                for text, passage, terms in candidates(hashes, bounds):
                    for unit, score in index.above(terms, threshold):
                        k = int(index.item[unit])
                        lo = max(bounds[text], bounds[text] + passage * UNIT - longest)
                        hi = min(bounds[text + 1], bounds[text] + (passage + 2) * UNIT + longest)
                        span = hashes[lo:hi]
                        shares = []
                        for part in index.parts[k]:
                            runs, _ = W.shingles(span, np.array([0, len(span)]), min(5, len(part)) or 1)
                            shares.append(_share(part, set(runs.tolist())))
                        if min(shares) >= overlap and score > best.get((text, k), (0,))[0] + 1e-12:
                            best[text, k] = (score, *shares, max(passage, 0) * UNIT)
                rows = [(ids[first + text].as_py(), index.item_ids[k], round(v[0], 6), round(v[1], 6), round(v[2], 6), v[3])
                        for (text, k), v in sorted(best.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64()))],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])
    return run


def _unit_words(batches):
    """(word, unit length) facts of items: one row per different word of a unit."""
    for batch in batches:
        q, a = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        hashes, bounds = hashes_of([x for pair in zip(q, a) for x in pair])
        words, first, size = [], [], []
        for k in range(len(q)):
            whole = hashes[bounds[2 * k]:bounds[2 * k + 2]]
            for at in range(0, len(whole), UNIT):
                unique = np.unique(whole[at:at + UNIT])
                words.append(unique.view(np.int64))
                first.append(np.arange(len(unique)) == 0)
                size.append(np.full(len(unique), min(UNIT, len(whole) - at)))
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (words, first, size)], ["word", "first", "size"])


def split_items(items: DataFrame) -> DataFrame:
    """(item_id, question, answer); a plain text's last quarter of words is its answer."""
    if {"question", "answer"} <= set(items.columns):
        return items.where(F.concat_ws(" ", "question", "answer").rlike(NOT_SIGN)).select(F.col("item_id").cast("long"), "question", "answer")
    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x.rlike(NOT_SIGN))
    cut = F.size(w) - F.greatest(F.lit(1), F.floor(F.size(w) / 4)).cast("int")
    return items.where("text is not null").select(F.col("item_id").cast("long"), w.alias("w"), cut.alias("cut")).where("size(w) > 0").select(
        "item_id", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("question"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("answer"))


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = 0.6, overlap: float = 0.8, index_words: int = 20_000_000) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of confirmed passages."""
    spark = docs.sparkSession
    items = split_items(items)
    facts = items.select("question", "answer").mapInArrow(_unit_words, "word long, first boolean, size long")
    counts = facts.groupBy("word").agg(F.count("*").alias("df"))
    total = facts.agg(F.sum(F.col("first").cast("long")).alias("units"), F.sum(F.when(F.col("first"), F.col("size"))).alias("words")).first()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    passes = -(-(total["words"] or 0) // index_words)
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "question"), F.lit(passes)) == k)
        rows = sorted((tuple(r) for r in part.collect()), key=str)
        if not rows:
            continue
        need = part.select("question", "answer").mapInArrow(_unit_words, "word long, first boolean, size long").select("word").distinct()
        frequency = {r["word"] % (1 << 64): r["df"] for r in counts.join(need, "word", "left_semi").collect()}
        index = build_index(rows, frequency, total["units"], total["words"] / total["units"], threshold)
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            yield from _passages(shared.value, threshold, overlap)(batches)

        found = texts.mapInArrow(W.trimmed(run), SCHEMA)
        out = found if passes == 1 else out.union(found)
    return out
