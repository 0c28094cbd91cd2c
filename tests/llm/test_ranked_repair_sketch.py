"""Conversation repair, ranked search and scaled sketches against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from tendero.llm import conversation_repair, ranked_search, scaled_sketch
from tendero.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SIGN = 1 << 63


def signed(v):
    return (v + SIGN) % (2 * SIGN) - SIGN


# --- conversation repair ---------------------------------------------------------------

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
PUT = {0: 2, 1: 2, 2: 3, 3: 2}
NONE = (10 ** 9, "")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), signed(xxhash.xxh64_intdigest(r[2].encode(), 42))))


def edits(rows):
    """Faults and (cost, audit) by a plain table of cost and whole string from the end."""
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.strip(" \t\n\x0b\f\r")
        faults.append("b" if not end else "d" if (role, text) in seen else "" if end[-1] in ".!?" else "t")
        seen.add((role, text))

    def with_inserts(v):
        for _ in range(4):
            v = [min(v[s], (v[PUT[s]][0] + 5, "I" + v[PUT[s]][1])) for s in range(4)]
        return v

    v = with_inserts([(0, ""), NONE, NONE, (0, "")])
    for (_, role, _), fault in zip(rows[::-1], faults[::-1]):
        w = []
        for s in range(4):
            ways = [(v[s][0] + 2, "D" + v[s][1])]
            if fault not in ("b", "d"):
                more = 5 * (fault == "t")
                if role[:1] in NEXT[s]:
                    to = v[NEXT[s][role[:1]]]
                    ways.append((to[0] + more, "K" + to[1]))
                ways.append((v[PUT[s]][0] + more + 1, "R" + v[PUT[s]][1]))
            w.append(min(ways))
        v = with_inserts(w)
    return faults, v[0]


def applied(rows, audit):
    out, state, rows = [], 0, iter(rows)
    for letter in audit:
        if letter == "I":
            role, text = None, ""
        else:
            _, role, text = next(rows)
        if letter == "D":
            continue
        state = NEXT[state][role[:1]] if letter == "K" else PUT[state]
        out.append((role if letter == "K" else "user" if state == 2 else "assistant", text))
    return out


def repaired(rows):
    faults, (cost, audit) = edits(rows)
    turns, roles = [r[0] for r in rows if r[0] is not None], [r[1][:1] for r in rows]
    lines = "\n".join(f"{r}:{t}" for r, t in applied(rows, audit))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in "bdt"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256(lines.encode()).hexdigest())


def made_up():
    r, rows = random.Random(5), []
    for conv in (None, *range(60)):
        for _ in range(r.choice([1, 2, 5, 9, 30])):
            rows.append((conv, r.choice([None, *range(12)]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                         r.choice(["a.", "b", "c!", " ", "", None, "d.\n", "e?\t", "f", "g", "h."])))
    # one conversation longer than a partition, with repeats far apart
    rows += [(777, k, r.choice(["user", "assistant", "user", "assistant", "system"]), f"x{r.randrange(1100)}" + r.choice([".", ".", "!", ""]))
             for k in range(1500)]
    return rows


def test_repair_is_the_cheapest_and_least(spark):
    rows = made_up()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost long, audit string")
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repaired_after_damage(df.repartition(5)).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert got == {k: repaired(damage(v)) for k, v in groups.items()}


def test_repaired_rows_alternate(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (1, 3, "assistant", "open"), (2, 0, "assistant", "z.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_repair.repaired_rows(conversation_repair.plain_rows(df)).orderBy("conv_id", "position").collect()
    want = {k: applied(x := [r[1:] for r in rows if r[0] == k], edits(x)[1][1]) for k in (1, 2)}
    assert [tuple(r)[2:] for r in got] == [*want[1], *want[2]]
    for k in (1, 2):
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in got if r.conv_id == k))


def test_halves_agree_with_the_whole_table():
    """The divided solution of one long stretch costs what the carried vector says."""
    import numpy as np
    r = np.random.default_rng(3)
    codes = r.integers(0, 9, 3000).astype(np.uint8)
    one = np.zeros(1, np.int64)
    cost, rank = conversation_repair.forward(codes, one, one + 3000, one)
    end = conversation_repair._end(cost, rank)
    said = conversation_repair.solved(codes, one, one + 3000, one, end)
    price = {"D": 2, "I": 5, "K": 0, "R": 1}
    total = sum(price[x] for way in said for x in way.decode()) + sum(5 for way, c in zip(said, codes) if c % 2 and c < 8 and way != b"D")
    assert total == cost[0, end[0]]


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repaired_after_damage(df).collect() == []


# --- ranked search ------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k=10):
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    found = [(i, x, sum(x.values())) for i, x in found if x]
    n_docs, all_terms = len(found), sum(n for *_, n in found)
    df = Counter(t for _, x, _ in found for t in x)
    queries = defaultdict(Counter)
    for item, text in set(items):
        queries[item] += Counter(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in queries.items():
        scores = []
        for i, x, n in found:
            m = 25 + 75 * n * n_docs // all_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * x[t] // (1000 * x[t] + 8 * m))
                    for t, times in terms.items() if t in x)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def search_rows():
    r = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "ΣΑΣ", "X1", "漢字"]
    docs = [(k * 3 % 401, " ".join(r.choice(words[:20] if k % 3 else words) for _ in range(r.choice([1, 4, 30, 90])))) for k in range(400)]
    docs += [(1000 + k, "copy of one text w1 w2 w3") for k in range(30)]  # ties beyond the tenth
    docs += [(None, "w1 w2"), (5, None), (6, ""), (7, "-- !!"), (8, "w1," * 3000), docs[3], docs[3]]
    items = [(k, " ".join(r.choice(words) for _ in range(25))) for k in range(20)]
    items += [(50, "copy W1 w2 w2"), (50, "copy W1 w2 w2"), (50, "text"), (51, None), (52, "nowhere"), (None, "w7 x1 one")]
    return docs, items


@pytest.mark.parametrize("block, leaf", [(16_000_000, 8192), (3000, 8)])
def test_search_equals_scoring_everything(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(ranked_search, "LEAF", leaf)
    docs, items = search_rows()
    df = spark.createDataFrame([(*d, 1, "b") for d in docs], "doc_id long, text string, score long, item_id string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    index = ranked_search.build(df, block_bytes=block)
    got = ranked_search.search(index, asked, most_terms=2_000_000 if block > 3000 else 60).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0, r[1])) == ranked(docs, items)


def test_intervals_equal_scoring_everything(monkeypatch):
    """Best-first search with the smallest leaves, every split and bound in use."""
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(ranked_search, "LEAF", 3)
    docs, items = search_rows()
    docs = [d for d in docs if d[0] is not None]
    column = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.string())], ["a", "b"])
    block, = ranked_search._blocks(1 << 30)([column])
    _, hashes, edges = next(ranked_search.term_hashes(pa.array([i[1] for i in items[:20]])))
    asked, codes = np.unique(hashes, return_inverse=True)
    lists = ranked_search.Lists(block.select(range(6)).to_pylist()[0], asked, block["documents"][0].as_py(), block["all_terms"][0].as_py())
    # bounds hold: the maximum of a stretch is that of its impacts
    a = np.array([0, 5, 9, 2]), np.array([4, 30, 10, 2])
    assert lists.maxima(*a).tolist() == [lists.table[0, x:y].max(initial=0) for x, y in zip(*a)]
    weights = np.array([ranked_search.weight(block["documents"][0].as_py(), n) for n in lists.ends - lists.starts])
    want = ranked(docs, items[:20])
    for q in range(20):
        best, (terms, times) = ranked_search.Best(10), np.unique(codes[edges[q]:edges[q + 1]], return_counts=True)
        ranked_search.search_block(lists, terms, weights[terms] * times, best)
        assert list(zip(best.ids.tolist(), best.scores.tolist())) == [r[2:] for r in want if r[0] == q]


def test_search_of_nothing(spark):
    nothing = spark.createDataFrame([], "doc_id long, item_id long, text string")
    some = spark.createDataFrame([(1, 1, "a b")], "doc_id long, item_id long, text string")
    assert ranked_search.search(ranked_search.build(nothing), some).collect() == []
    assert ranked_search.search(ranked_search.build(some), nothing).collect() == []


# --- scaled sketches -------------------------------------------------------------------------

def hashed(values):
    h = 42
    for form, v in values:
        h = xxhash.xxh64_intdigest(struct.pack(form, v), h)
    return signed(h)


def all_hashes(text):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return set()
    return {hashed(("<Q", w) for w in words[k:k + 5]) for k in range(len(words) - 4)}


def sketch(text):
    hashes = all_hashes(text)
    return sorted(h for h in hashes if h < scaled_sketch.limit(8)) or sorted(hashes)[:1]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(n))


def fingerprint_rows():
    docs = [(k, prose(k, 5 + k * 7)) for k in range(40)] + [(100 + k, prose(3, 60)) for k in range(5)]
    docs += [(200, None), (201, ""), (202, " \t\n"), (203, "two words"), (204, "two words"), (205, prose(9, 9000)), (206, "É ﬁ 漢字 😀 x y z")]
    docs += [(300, prose(1, 30)), (300, prose(2, 30)), (300, prose(2, 30)), (None, prose(4, 40)), (None, prose(5, 40)), (None, prose(5, 40))]
    return docs


@pytest.mark.parametrize("range_rows", [100_000, 2])
def test_fingerprints(spark, monkeypatch, range_rows):
    monkeypatch.setattr(scaled_sketch, "RANGE_ROWS", range_rows)
    docs = fingerprint_rows()
    df = spark.createDataFrame([(*d, 1, "r") for d in docs], "doc_id long, text string, n_chars long, range string").repartition(4)
    got = scaled_sketch.fingerprints(df).collect()
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, signed(xxhash.xxh64_intdigest((d[1] or "").encode(), 42))))
    want = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        want.append((i is not None, i or 0, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    for k, (i, text) in enumerate(order):
        words = len((text or "").split())
        if i is None or i == 300 or 0 < words < 5 or i == 201:
            continue
        row = next(r for r in got if r.doc_id == i)
        after = order[(k + 1) % len(order)][1] or ""
        if words:
            assert row.fingerprint == "".join(f"{h % (2 * SIGN):016X}" for h in sketch(text))
        if len(after.split()) >= 5 or not after.split():
            a, b = set(sketch(text or "")), set(sketch(after))
            assert row.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
            assert row.held_next == pytest.approx(len(a & b) / len(a) if a else 1.0)
    by_text = defaultdict(set)
    for r, (i, t) in ((r, d) for r in got for d in docs if d[0] == r.doc_id and docs.count(d) == 1 and i_once(docs, d[0])):
        by_text[t].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def i_once(docs, i):
    return sum(d[0] == i for d in docs) == 1


def test_sketches_merge_and_measure_containment(spark):
    whole, part = prose(11, 4000), " ".join(prose(11, 4000).split()[1000:1400])
    df = spark.createDataFrame([(1, whole, part), (2, part, prose(12, 900))], "id long, a string, b string")
    df = scaled_sketch.with_sketch(scaled_sketch.with_sketch(df, "a", "x"), "b", "y")
    rows = df.select("id", "x", "y", scaled_sketch.merged("x", "y").alias("both"), scaled_sketch.containment(df.y, df.x).alias("held")).collect()
    for r, (a, b) in zip(rows, ((whole, part), (part, prose(12, 900)))):
        low = sorted(h for h in all_hashes(a) | all_hashes(b) if h < scaled_sketch.limit(8))
        assert r.both == low
        assert r.held == pytest.approx(len(set(r.x) & set(r.y)) / len(r.y))
    assert rows[0].held == 1.0 and rows[1].held < 0.05
    grouped = scaled_sketch.merged_rows(df.selectExpr("1 as g", "x"), "g", "x").collect()
    assert sorted(r.hash for r in grouped) == sorted(h for h in all_hashes(whole) if h < scaled_sketch.limit(8))


def test_sketch_estimates_follow_the_texts(spark):
    """Mean error of the estimated likeness of pairs that share half of their shingles."""
    pairs = [(k, prose(100 + k, 600), " ".join(prose(100 + k, 600).split()[:400]) + " " + prose(900 + k, 200)) for k in range(40)]
    df = spark.createDataFrame(pairs, "id long, a string, b string")
    df = scaled_sketch.with_sketch(scaled_sketch.with_sketch(df, "a", "x"), "b", "y")
    got = [r.near for r in df.orderBy("id").select(scaled_sketch.likeness(df.x, df.y).alias("near")).collect()]
    true = [len(all_hashes(a) & all_hashes(b)) / len(all_hashes(a) | all_hashes(b)) for _, a, b in pairs]
    assert abs(sum(got) / 40 - sum(true) / 40) < 0.03


def test_fingerprints_of_nothing_and_of_one(spark):
    assert scaled_sketch.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    row, = scaled_sketch.fingerprints(spark.createDataFrame([(4, prose(1, 50))], "doc_id long, text string")).collect()
    text = prose(1, 50)
    assert row.edited_sha256 == hashlib.sha256((text[:len(text) - len(text) // 2] + text[:len(text) // 2]).encode()).hexdigest()


@pytest.mark.parametrize("key", ["op11_hirschberg_repair", "op12_ranked_search", "op13_scaled_sketch"])
def test_queries_cover_their_tables(spark, key):
    got = QUERIES[key](spark, DATA)
    name = {"op11": "conversations", "op12": "benchmark", "op13": "documents"}[key[:4]]
    column = {"op11": "conv_id", "op12": "item_id", "op13": "doc_id"}[key[:4]]
    assert got.select(column).distinct().count() == spark.read.parquet(f"{DATA}/{name}.parquet").select(column).distinct().count()
