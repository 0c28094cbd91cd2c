"""Language-model scores from a log-frequency Bloom filter that is broadcast to the workers.

Counts c of words and word pairs are stored as levels 1 + floor(log_b c). An n-gram of
level q enters the filter q times, as (n-gram, 1) ... (n-gram, q); asking for (n-gram, 1),
(n-gram, 2), ... until one is missing gives the level back, never too low.

1. Texts become *blocks* once: the different words of some megabytes of text, and every
   token as a place in that list.
2. A block sends its training n-grams and their counts, one entry for each different one,
   packed by ranges of hashes; a range adds them up and fills its part of the filter. For
   words it also gives each block the exact counts, which the base score needs.
3. The parts are stored. They are broadcast in groups of at most ``GROUP_BYTES``; for each
   group one pass over the blocks asks for the n-grams of its ranges.
4. A block's levels meet its tokens and give the scores.

The filter has ``BITS`` bits for every entry whatever the size of the corpus, and no process
holds more of it than a group. Each group is a pass over the blocks, so ``group_bytes`` should
follow the memory that workers have.

Probabilities: a word alone has (value of its level + 0.1) / (S + 0.1 (V + 1)), where S adds up
the values of all V words as the filter gives them; over all known words and one unknown
these are 1. After a known word the pair adds ``weight`` times the least count of its level
over the largest count of the first word's level, so the shares of all pairs that occur stay
within 1. A pair is never given a level above those of its two words.

Rows: null and empty texts are one end token; null ids are not trained on and count as
held out; repeated rows are counted and scored one by one; long texts are taken whole;
with nothing to train on, all tokens are unknown.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendero.llm import words as W
from tendero.llm.quality_classifier import remainder
from tendero.session import stored

PIECE = 1_000_000  # bytes of text that are hashed at a time
BLOCK = 8_000_000  # bytes of text of a block
RANGE_ENTRIES = 1_000_000  # packed entries that one range adds up
GROUP_BYTES = 64_000_000  # filter bytes that a worker holds at a time
BITS, PROBES, BASE = 10, 6, 1.5
LEVELS = 80
WEIGHT = 0.3  # share of the pair in a token's probability
END = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = "block long, ids array<long>, held array<boolean>, lengths binary, tokens binary, words binary, counts binary, n long, n_words long"
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """An array as compressed bytes: all first bytes of its values, all second bytes, and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1)


def _block_row(ids: list, held: list, tokens: list, lengths: list) -> pa.RecordBatch:
    lengths, held = np.concatenate(lengths), [x for part in held for x in part.to_pylist()]
    words, place = np.unique(np.concatenate(tokens), return_inverse=True)
    train = np.repeat(~np.array(held, bool), lengths)
    counts = np.bincount(place[train], minlength=len(words))
    columns = [uuid.uuid4().int >> 65, [x for part in ids for x in part.to_pylist()], held, pack(lengths.astype(np.int64)),
               pack(place.astype(np.int32)), pack(words), pack(counts.astype(np.uint32)), len(place), len(words)]
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4, pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)],
                                      ["block", "ids", "held", "lengths", "tokens", "words", "counts", "n", "n_words"])


def _blocks(batches):
    parts, size = ([], [], [], []), 0
    for batch in batches:
        for first, end, data, offsets in W.slices(batch.column(2), PIECE):
            n = end - first
            starts, ends, bounds = W.word_spans(data, offsets)
            hashes = W.word_hashes(W.LOWER[data], starts, ends)
            edges = bounds + np.arange(n + 1)
            tokens = np.empty(edges[-1], np.uint64)
            last = np.zeros(len(tokens), bool)
            last[edges[1:] - 1] = True
            tokens[last], tokens[~last] = END, hashes
            for part, x in zip(parts, (batch.column(0).slice(first, n), batch.column(1).slice(first, n), tokens, np.diff(edges))):
                part.append(x)
            size += len(data) + n
            if size >= BLOCK:
                yield _block_row(*parts)
                parts, size = ([], [], [], []), 0
    if size:
        yield _block_row(*parts)


class Block:
    """Arrays of one stored block; fields are unpacked when they are asked for."""

    def __init__(self, batch, row: int = 0):
        self.row = {name: batch.column(k)[row] for k, name in enumerate(batch.schema.names)}
        self.id = self.row["block"].as_py()
        self.words = self._array("words", np.uint64)

    def _array(self, name: str, kind) -> np.ndarray:
        return unpack(self.row[name].as_py(), kind)

    def counts(self) -> np.ndarray:
        """Training count of each word."""
        return self._array("counts", np.uint32)

    def read_tokens(self) -> None:
        self.tokens, self.lengths = self._array("tokens", np.int32), self._array("lengths", np.int64)
        self.first = np.zeros(len(self.tokens), bool)
        self.first[np.cumsum(self.lengths) - self.lengths] = True

    def pairs(self) -> np.ndarray:
        """Hash of each token but the first of a text, with the one before it."""
        self.read_tokens()
        w = self.words[self.tokens]
        return W.mix(w[:-1] * _STEP + w[1:])[~self.first[1:]]

    def trained(self) -> np.ndarray:
        """Which of ``pairs`` are learnt from."""
        return np.repeat(~np.array(self.row["held"].as_py(), bool), self.lengths - 1)


def _each(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch, row)


def _entries(kind: str, bits: int):
    """A block's words, or its training pairs, with their training counts by range."""
    def run(batches):
        for block in _each(batches):
            if kind == "words":
                hashes, counts = block.words, block.counts()
            else:
                pairs = block.pairs()
                hashes, counts = np.unique(pairs[block.trained()], return_counts=True)
                counts = counts.astype(np.uint32)
            if not len(hashes):
                continue
            of = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)]))
            for at in range(0, len(cut) - 1, 16):
                some = list(zip(cut[at:-1][:16].tolist(), cut[at + 1:][:16].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(of[a]) for a, _ in some], pa.int64()), pa.array([block.id] * len(some), pa.int64()),
                     pa.array([pack(hashes[a:b]) for a, b in some], pa.binary()), pa.array([pack(counts[a:b]) for a, b in some], pa.binary())],
                    ["range", "block", "hashes", "counts"])
    return run


_ENTRIES = "range long, block long, hashes binary, counts binary"


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9), LEVELS).astype(np.int64)


_LOW = np.ceil(BASE ** np.arange(LEVELS) - 1e-9)
_HIGH = np.maximum(np.ceil(BASE ** np.arange(1, LEVELS + 1) - 1e-9) - 1, _LOW)
#: Count that a level stands for, the least and the largest one; level 0 is none.
VALUE, LEAST, MOST = (np.concatenate(([0.0], x)) for x in (np.sqrt(_LOW * _HIGH), _LOW, _HIGH))


def _probes(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First probe of n-grams at a level and the step to the next ones, both before the remainder by the part's size."""
    h = W.mix(hashes + np.uint64(level * int(_STEP) % (1 << 64)))
    return h, W.mix(h) | np.uint64(1)


def filled(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """The part of the filter that holds these n-grams."""
    level = levels(counts)
    size = max(64, int(level.sum() * BITS)) // 8 * 8 + 8
    part = np.zeros(size, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        at, step = _probes(hashes[level >= q], q)
        for _ in range(PROBES):
            part[at % np.uint64(size)] = 1
            at += step
    return np.packbits(part, bitorder="little").tobytes()


class Filter:
    """Parts of the filter, of the ranges ``first``, ``first + 1``, ...; ``level`` asks for many n-grams at once."""

    def __init__(self, parts: list[bytes], first: int = 0, bits: int = 0):
        sizes = [len(p) for p in parts]
        self.bits, self.first, self.end = bits, first, first + len(parts)
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.start = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.uint64) * np.uint64(8)
        self.size = np.array(sizes, np.uint64) * np.uint64(8)

    def range_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """Levels of n-grams that all lie in the ranges held here."""
        out, active, part = np.zeros(len(hashes), np.uint8), np.arange(len(hashes)), self.range_of(hashes) - self.first
        start, size = self.start[part], self.size[part]
        for q in range(1, LEVELS + 1):
            at, step = _probes(hashes, q)
            for _ in range(PROBES):
                bit = start + at % size
                hit = (self.data[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                # what misses a probe is asked no more; the other fields follow
                active, hashes, start, size, at, step = (x[hit] for x in (active, hashes, start, size, at, step))
                at += step
            out[active] = q
            if not len(active):
                break
        return out


def _summed(table: pa.Table):
    hashes = [unpack(x.as_py(), np.uint64) for x in table["hashes"]]
    counts = np.concatenate([unpack(x.as_py(), np.uint32) for x in table["counts"]])
    edges = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
    unique, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    # two halves keep sums exact in doubles
    low, high = (np.bincount(inverse, x, len(unique)).astype(np.int64) for x in (counts & 0xFFFF, counts >> 16))
    return edges, inverse, unique, low + (high << 16)


def _counted(answers: bool):
    """A range's part of the filter with its totals, and for each block the whole corpus's counts of its entries."""
    def run(table: pa.Table) -> pa.Table:
        edges, inverse, hashes, sums = _summed(table)
        known = sums > 0
        part = filled(hashes[known], sums[known])
        value = float(VALUE[Filter([part]).level(hashes[known])].sum())
        blocks = table["block"].to_pylist() if answers else []
        counts = [pack(sums[inverse[a:b]]) for a, b in zip(edges[:-1], edges[1:])] if answers else []
        more = len(blocks)
        return pa.table({
            "range": pa.array(table["range"][:1].to_pylist() * (1 + more), pa.int64()), "block": pa.array([None, *blocks], pa.int64()),
            "counts": pa.array([None, *counts], pa.binary()), "part": pa.array([part] + [None] * more, pa.binary()),
            "bytes": pa.array([len(part)] + [None] * more, pa.int64()), "distinct": pa.array([int(known.sum())] + [None] * more, pa.int64()),
            "tokens": pa.array([int(sums.sum())] + [None] * more, pa.int64()), "value": pa.array([value] + [None] * more, pa.float64())})
    return run


_COUNTED = "range long, block long, counts binary, part binary, bytes long, distinct long, tokens long, value double"


def _probed(number: int, words, pairs):
    """Levels of each block's words and pairs that lie in the ranges of one group (broadcast filters, or none)."""
    def found(shared, hashes):
        if shared is None:
            return pack(np.zeros(0, np.uint8))
        of = shared.value.range_of(hashes)
        # only what lies in the group is sorted; words come sorted already
        some = hashes[(of >= shared.value.first) & (of < shared.value.end)]
        return pack(shared.value.level(some if shared is words else np.unique(some)))

    def run(batches):
        for block in _each(batches):
            of_pairs = found(pairs, block.pairs() if pairs else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.id], pa.int64()), pa.array([number], pa.int64()), pa.array([found(words, block.words)], pa.binary()), pa.array([of_pairs], pa.binary())],
                ["block", "range", "word_levels", "pair_levels"])
    return run


def _groups(sizes: list[tuple[str, int, int]], most: int) -> list[dict[str, tuple[int, int]]]:
    """Ranges (kind, range, bytes) in their order, cut where a group would hold more than ``most`` bytes: first range and end by kind."""
    groups, held = [], most + 1
    for kind, at, size in sizes:
        if held + size > most:
            groups.append({})
            held = 0
        groups[-1][kind] = (groups[-1].get(kind, (at,))[0], at + 1)
        held += size
    return groups


def _scores(tokens: int, distinct: int, value: float, weight: float):
    total, mass = tokens + 0.1 * (distinct + 1), value + 0.1 * (distinct + 1)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left)
        right = right.sort_by("range")
        join = lambda name, kind: np.concatenate([unpack(x.as_py(), kind) for x in right[name] if x.is_valid] or [np.zeros(0, kind)])
        exact, word, pair = join("counts", np.int64), join("word_levels", np.uint8), join("pair_levels", np.uint8)
        _, place = np.unique(block.pairs(), return_inverse=True)
        token, begins = block.tokens, np.cumsum(block.lengths) - block.lengths
        base = np.log10((exact + 0.1) / total)
        p = ((VALUE[word] + 0.1) / mass)[token]
        later = np.flatnonzero(~block.first)
        before, here = word[token[later - 1]], word[token[later]]
        share = LEAST[np.minimum(pair[place], np.minimum(before, here))] / np.maximum(MOST[before], 1.0)
        after_known = before > 0
        at = later[after_known]
        p[at] = weight * share[after_known] + (1 - weight) * p[at]
        add = lambda x: np.add.reduceat(x, begins)
        ids, held = block.row["ids"].as_py(), block.row["held"].as_py()
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(block.lengths),
            "n_known": pa.array(add((exact > 0).astype(np.int64)[token])), "train_tokens": pa.array(np.full(len(ids), tokens)),
            "base_score": pa.array(add(base[token])), "score": pa.array(add(np.log10(p)))})
    return run


def _bits(entries: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, entries / RANGE_ENTRIES)))))


def lm_scores(docs: DataFrame, *, folds: int = 10, weight: float = WEIGHT, group_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``group_bytes``: filter bytes that are broadcast at a time (``GROUP_BYTES``); the scores don't depend on it.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, folds) == 0).alias("held"), F.col(text_col).alias("text"))
    blocks = stored(texts.mapInArrow(_blocks, _BLOCKS), "blocks")
    facts = blocks.agg(F.sum("n_words").alias("words"), F.sum("n").alias("n")).first()
    if facts["words"] is None:
        return spark.createDataFrame([], _RESULT)
    bits = {"words": _bits(facts["words"]), "pairs": _bits(facts["n"])}
    counted = {kind: stored(blocks.mapInArrow(_entries(kind, bits[kind]), _ENTRIES).groupBy("range").applyInArrow(_counted(kind == "words"), _COUNTED), kind)
               for kind in bits}
    parts = {kind: counted[kind].where("block is null") for kind in bits}
    totals = parts["words"].agg(F.sum("distinct").alias("v"), F.sum("tokens").alias("n"), F.sum("value").alias("value")).first()
    sizes = []
    for kind in bits:
        have = {r["range"]: r["bytes"] for r in parts[kind].select("range", "bytes").collect()}
        sizes += [(kind, k, have.get(k, 0)) for k in range(1 << bits[kind])]
    facts_of = counted["words"].where("block is not null").select("block", "range", "counts")
    empty = filled(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for number, group in enumerate(_groups(sizes, group_bytes or GROUP_BYTES)):
        shared = {}
        for kind, (first, end) in group.items():
            rows = dict(parts[kind].where(F.col("range").between(first, end - 1)).select("range", "part").collect())
            shared[kind] = spark.sparkContext.broadcast(Filter([bytes(rows.get(k, empty)) for k in range(first, end)], first, bits[kind]))
            del rows
        asked = stored(blocks.mapInArrow(_probed(number, shared.get("words"), shared.get("pairs")), "block long, range long, word_levels binary, pair_levels binary"), "levels")
        for one in shared.values():
            one.destroy()
        facts_of = facts_of.unionByName(asked, allowMissingColumns=True)
    return blocks.groupBy("block").cogroup(facts_of.groupBy("block")).applyInArrow(
        _scores(totals["n"], totals["v"], totals["value"], weight), _RESULT)
