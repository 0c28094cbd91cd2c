"""SuperMinHash near-duplicate groups: signatures, banding, verification, union-find.

A document's set is its distinct word shingles. In a SuperMinHash signature every
element ranks the slots by its own random permutation: step j of an element writes
``j + random`` into one slot, so a slot of a long text is settled in the first step or
two and the rest of the permutations is never drawn (a document stops as soon as no
further step could lower a slot).

Links are complete without writing out all pairs of a group:

1. documents with equal sets are one class, kept by its smallest id;
2. in every bucket of equal bands each class meets the bucket's most connected class,
   and the pair is confirmed on full sets;
3. in buckets whose classes still lie in several components, tasks compare signatures
   block against block: first each class meets the most similar class of another
   component, then all pairs that signatures cannot rule out are compared on sets, each
   in the first band they share; only links come out of the tasks, and are confirmed.

Rows: null or empty texts and texts without words have no set and no link. Rows of one
document id count as one document. A null id is a document of its own with a null
component. Long texts are taken whole. Other columns do not take part.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendero.llm import words as W
from tendero.llm.components import components
from tendero.session import stored

STEP = 40  # bits of the random part of a slot's value; the step stands above
BLOCK_BYTES = 1_000_000  # set or signature bytes of a block of a comparison
SET_BYTES = 1_000_000  # bytes of text whose shingles are held at a time: some 150 bytes of arrays for each
TILE = 8192  # different shingles counted at once
SENT_ROWS = 1_000_000  # ids or pairs that go to every task to pick texts: 24 bytes each; more meet the texts in a shuffle
MEMBERS = 256  # sets that are compared with one hub's set in one group


def text_sets(column: pa.Array, width: int, lower: bool = True):
    """(first row, shingles, edges) of slices of a text column; sorted, distinct per text."""
    for at, _, data, offsets in W.slices(column, SET_BYTES):
        if lower:
            data = W.LOWER[data]
        starts, ends, bounds = W.word_spans(data, offsets)
        yield (at, *W.distinct_per_text(*W.shingles(W.word_hashes(data, starts, ends), bounds, width)))


def signatures(values: np.ndarray, edges: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of each text's set: rows of ``slots`` values (all ones where a set is empty)."""
    texts = len(edges) - 1
    best = np.full(texts * slots, np.iinfo(np.uint64).max, np.uint64)
    row = np.repeat(np.arange(texts), np.diff(edges))
    x, order = values, None
    for step in range(slots):
        draw = W.mix(x + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        pick = step + ((draw & np.uint64(0xFFFFFF)) * np.uint64(slots - step) >> np.uint64(24)).astype(np.int64)
        if step == 0:
            slot = pick
        else:
            at = np.arange(len(x))
            slot = order[at, pick].astype(np.int64)
            order[at, pick] = order[:, step]
        np.minimum.at(best, row * slots + slot, (draw >> np.uint64(64 - STEP)) + np.uint64(step << STEP))
        # a text goes on while a later step could still lower one of its slots
        open_ = best.reshape(texts, slots).max(1) >= np.uint64((step + 1) << STEP)
        go = open_[row]
        if not go.any():
            break
        if step == 0:
            x, row, pick = x[go], row[go], pick[go]
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(x), 1))
            order[np.arange(len(x)), pick] = 0
        elif go.mean() < 0.7:
            x, row, order = x[go], row[go], order[go]
    return best.reshape(texts, slots)


def _sketches(width: int, bands: int, band: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, values, edges in text_sets(batch.column(1), width):
                n = np.diff(edges)
                sums = [np.concatenate(([0], np.cumsum(W.mix(values + np.uint64(k)), dtype=np.uint64))).astype(np.uint64)
                        for k in (11, 12)]
                keys = [(s[edges[1:]] - s[edges[:-1]]).view(np.int64) for s in sums]
                slots = W.mix(signatures(values, edges, bands * band))
                rolled = np.zeros((len(n), bands), np.uint64)
                for k in range(band):
                    rolled = W.mix(rolled + slots[:, k::band])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(n)), pa.array(n, pa.int64()), pa.array(keys[0]), pa.array(keys[1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()),
                                             pa.array(rolled.ravel().view(np.int64))),
                    pa.array([r.tobytes() for r in (slots & np.uint64(255)).astype(np.uint8)], pa.binary()),
                ], ["doc_id", "n_shingles", "key1", "key2", "bands", "sig"])
    return run


def _sets(width: int, short: bool = False):
    """The columns before the text, and the text's set as 64-bit values, or as distinct 32-bit ones (``short``)."""
    def run(batches):
        for batch in batches:
            last = batch.num_columns - 1
            for at, values, edges in text_sets(batch.column(last), width):
                sets = pa.array([(np.unique(values[a:b].astype(np.uint32)) if short else values[a:b]).tobytes()
                                 for a, b in zip(edges[:-1], edges[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(sets)) for k in range(last)), sets],
                                                 [*batch.schema.names[:last], "set"])
    return run


def _alike(agree: int):
    """Pairs of signatures with at least ``agree`` equal slots."""
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array((a == b).sum(1) >= agree) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select([0, 1]).filter(keep)
    return run


def _confirmed(sim: Fraction):
    """Members of a block whose sets are similar to their hub's."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            hub = np.frombuffer(right["set"][0].as_buffer(), np.uint64)
            for chunk, ids in zip(left["set"].chunks, left["id"].chunks):
                for x, member in zip(chunk, ids.to_pylist()):
                    x = np.frombuffer(x.as_buffer(), np.uint64)
                    both = len(np.intersect1d(hub, x, assume_unique=True))
                    if both > 0 and both * sim.denominator >= sim.numerator * (len(x) + len(hub) - both):
                        found.append(member)
        return pa.table({"a": pa.array(left["a"][:1].to_pylist() * len(found), pa.int64()), "b": pa.array(found, pa.int64())})
    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of 0/1 matrices, tile by tile."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    counts = np.zeros((len(left), len(right)), np.float32)

    def cells(values, lists):
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        col = np.searchsorted(shared, values)
        col[col == len(shared)] = 0
        hit = shared[col] == values
        order = np.argsort(col[hit], kind="stable")
        return row[hit][order], col[hit][order]

    if not len(shared):
        return counts
    (ra, ca), (rb, cb) = cells(a, left), cells(b, right)
    for at in range(0, len(shared), TILE):
        width = min(TILE, len(shared) - at)
        one, two = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for m, r, c in ((one, ra, ca), (two, rb, cb)):
            lo, hi = np.searchsorted(c, (at, at + width))
            m[r[lo:hi], c[lo:hi] - at] = 1
        counts += one @ two.T
    return counts


def _columns(table: pa.Table, name: str, kind) -> tuple:
    return table["id"].to_numpy(), table["label"].to_numpy(), [np.frombuffer(x, kind) for x in table[name].to_pylist()]


def _block_suspects(band: int, agree: int, best: bool):
    """Pairs of different components that may be similar, in the first band that they share.

    ``best``: for each class of the left side the most similar one, as a pair; else the
    classes that take part in any pair, each with itself.
    """
    empty = pa.table({"band": pa.array([], pa.int32()), "value": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        here, value = key[0].as_py(), key[1].as_py()
        (ia, la, sa), (ib, lb, sb) = _columns(left, "sig", np.uint8), _columns(right, "sig", np.uint8)
        sa, sb = np.array(sa), np.array(sb)
        used_a, used_b, pairs = np.zeros(len(ia), bool), np.zeros(len(ib), bool), []
        step = max(1, 20_000_000 // sb.size)
        for at in range(0, len(ia), step):
            same = sa[at:at + step, None, :] == sb[None, :, :]
            equal = same.sum(2)
            open_ = (equal >= agree) & (la[at:at + step, None] != lb[None, :])
            rows, cols = np.nonzero(open_)
            if len(rows):
                shared = same[rows, cols].reshape(len(rows), -1, band).all(2).argmax(1) == here
                rows, cols = rows[shared], cols[shared]
            used_a[at + rows], used_b[cols] = True, True
            if best and len(rows):
                order = np.lexsort((cols, -equal[rows, cols], rows))
                first = order[np.concatenate(([True], np.diff(rows[order]) > 0))]
                pairs += zip(ia[at + rows[first]].tolist(), ib[cols[first]].tolist())
        if not best:
            used = np.unique(np.concatenate((ia[used_a], ib[used_b]))).tolist()
            pairs = list(zip(used, used))
        return pa.table({"band": pa.array([here] * len(pairs), pa.int32()), "value": pa.array([value] * len(pairs), pa.int64()),
                         "a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})
    return run


def _block_links(sim: Fraction):
    """Pairs of different components whose sets are similar; sets are given by 32 bits an element."""
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        (ia, la, sa), (ib, lb, sb) = _columns(left, "set", np.uint32), _columns(right, "set", np.uint32)
        both = common_counts(sa, sb)
        sizes = np.array([len(x) for x in sa])[:, None] + np.array([len(x) for x in sb])[None, :]
        hit = (both * sim.denominator >= sim.numerator * (sizes - both)) & (both > 0) & (la[:, None] != lb[None, :])
        a, b = np.nonzero(hit)
        return pa.table({"a": ia[a], "b": ib[b]})
    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    similarity: str = "0.8", bands: int = 32, band: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    ``bands`` of ``band`` slots each: at the similarity s a pair meets in no bucket with
    probability (1 - s^band)^bands; the defaults give 5e-8 at 0.8.
    """
    sim = Fraction(similarity)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(texts.mapInArrow(
        W.trimmed(_sketches(width, bands, band)), "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, sig binary"), "sketches")

    # 1. classes of equal sets, known by their smallest id
    same = ["n_shingles", "key1", "key2"]
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(
        F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sig", "doc_id").alias("sig"))
    classes = stored(classes, "classes")

    size = classes.select("id", "n_shingles", "sig")
    # four standard deviations of the share of equal slots below the similarity
    agree = int(bands * band * float(sim) - 4 * (bands * band * float(sim) * (1 - float(sim))) ** 0.5)

    def chosen(wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` (doc_id, ...) with their texts; few are sent to the texts, so that no text is shuffled to meet them."""
        few = wanted.count() <= SENT_ROWS
        return texts.join(F.broadcast(wanted) if few else wanted, "doc_id").select(*wanted.columns, "text")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with similar full sets: every block of the ``b`` of an ``a`` meets its set once."""
        blocks = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("blocks")), "hubs")
        dealt = stored(pairs.join(blocks, "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")), "members")
        members = chosen(dealt).mapInArrow(W.trimmed(_sets(width)), "id long, a long, block long, set binary")
        hubs = chosen(blocks.withColumnRenamed("a", "doc_id")).mapInArrow(W.trimmed(_sets(width)), "a long, blocks long, set binary").select(
            "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "set")
        return stored(members.groupBy("a", "block").cogroup(hubs.groupBy("a", "block")).applyInArrow(_confirmed(sim), "a long, b long"), "confirmed")

    # 2. each class with the most connected class of each of its buckets
    slots = classes.select("id", F.posexplode("bands").alias("band", "value"))
    busy = slots.groupBy("band", "value").agg(F.count("*").alias("members")).where("members > 1")
    slots = stored(slots.join(busy, ["band", "value"]), "buckets")
    ties = slots.groupBy("id").agg(F.sum("members").alias("ties"))
    hubs = slots.join(ties, "id").groupBy("band", "value").agg(
        F.min(F.struct(-F.col("ties"), F.col("id"))).getField("id").alias("hub"))
    pairs = (slots.join(hubs, ["band", "value"]).where("id != hub")
             .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    pairs = (pairs.join(size.toDF("a", "na", "sa"), "a").join(size.toDF("b", "nb", "sb"), "b")
             .where(F.least("na", "nb") * sim.denominator >= F.greatest("na", "nb") * sim.numerator)
             .select("a", "b", "sa", "sb").mapInArrow(_alike(agree), "a long, b long"))
    links = confirmed(stored(pairs, "pairs"))
    found = stored(components(links), "components")

    # 3. buckets that still hold several components (a bucket of two was compared by step 2)
    crowded = slots.where("members > 2")
    key = ["band", "value"]
    side = [*key, "left", "right"]

    def mixed() -> DataFrame:
        named = crowded.join(found.withColumnRenamed("node", "id"), "id", "left").select(
            *key, "id", F.coalesce("component", "id").alias("label"))
        main = (named.groupBy(*key, "label").agg(F.count("*").alias("n"))
                .groupBy(*key).agg(F.max(F.struct("n", "label")).getField("label").alias("main"), F.count("*").alias("labels")).where("labels > 1"))
        return named.join(main, key)

    def blocks(members: DataFrame, data: DataFrame, name: str, fn, schema: str) -> DataFrame:
        """``fn`` over all pairs of blocks of a bucket: classes outside its main component against all."""
        parts = members.groupBy(*key).agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("blocks"))
        tagged = (members.join(parts, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(data, "id"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        one = tagged.where("label != main").withColumn("left", F.col("block")).withColumn("right", every).select(*side, "id", "label", name)
        two = tagged.withColumn("right", F.col("block")).withColumn("left", every).select(
            *[F.col(c).alias(f"_{c}") for c in (*side, "id", "label", name)]).toDF(*side, "id", "label", name)
        return one.groupBy(*side).cogroup(two.groupBy(*side)).applyInArrow(fn, schema)

    suspect_schema = "band int, value long, a long, b long"
    signs = size.select("id", "sig")
    near = lambda members, best: blocks(
        members.withColumn("bytes", F.lit(bands * band)), signs, "sig", _block_suspects(band, agree, best), suspect_schema)
    best = near(mixed(), True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.union(confirmed(stored(best, "best")))
    found = stored(components(links), "components")
    members = stored(mixed(), "mixed")
    suspects = stored(near(members, False).select(*key, F.col("a").alias("id")).distinct(), "suspects")
    wanted = suspects.select(F.col("id").alias("doc_id")).distinct()
    short = stored(chosen(stored(wanted, "wanted")).mapInArrow(W.trimmed(_sets(width, short=True)), "id long, set binary").dropDuplicates(["id"]), "sets")
    last = blocks(members.join(suspects, [*key, "id"], "left_semi").join(size.select("id", (F.col("n_shingles") * 4).alias("bytes")), "id"),
                  short, "set", _block_links(sim), "a long, b long")
    last = last.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.union(confirmed(stored(last, "late")))
    found = stored(components(links), "components")

    # every row of a class has the class's component; ids of several classes join them
    named = rows.join(classes.select(*same, F.col("id").alias("node")), same, "left") \
        .join(found, "node", "left") \
        .withColumn("component_id", F.coalesce("component", "node", "doc_id"))
    return named.select("doc_id", "n_shingles", "component_id",
                        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
