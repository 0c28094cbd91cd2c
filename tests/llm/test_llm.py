"""The corpus operators against brute force, on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import io
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from tendero.llm import (decontamination, lm_scoring, near_duplicates, quality_classifier, quality_rules, secrets, sentencepiece_bpe,
                         sharding, substring_dedup, token_files)
from tendero.llm import words as W
from tendero.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, slot long, shard string, ids string, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), 4)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, other = prose(1, 120), prose(2, 90)
    near = " ".join(w if k != 60 else "changed" for k, w in enumerate(base.split()))
    secret = f'{prose(3, 20)} token = "0123456789abcdef0123456789abcdef01234567" {prose(4, 20)} 4532123412341234 {prose(5, 9)}'
    texts = [base, near, base, other, None, "", "  \t\n ", "one", "two words", base.upper(), prose(6, 30) + " " + other + " " + prose(7, 30),
             "x" * 50_000, prose(8, 6000), secret, "É ﬁ ▁ <s> 漢字 😀 \x01", None]
    ids = [*range(len(texts) - 1), None]
    out = [(i, t, "en" if i != 3 else None, None if i == 2 else "src", 1, 2, 3, "s", "i", 4) for i, t in zip(ids, texts)]
    return [*out, out[0]]  # and one row twice


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def test_words_and_shingles(rows):
    texts = [r[1] for r in rows]
    hashes = {}
    for first, end, data, offsets in W.slices(pa.array(texts, pa.string()), 3000):
        starts, ends, bounds = W.word_spans(data, offsets)
        h = W.word_hashes(W.LOWER[data], starts, ends)
        for k in range(end - first):
            want = words(texts[first + k])
            assert bounds[k + 1] - bounds[k] == len(want)
            for w, x in zip(want, h[bounds[k]:bounds[k + 1]].tolist()):
                assert hashes.setdefault(w, x) == x
        values, edges = W.distinct_per_text(*W.shingles(h, bounds, 3))
        for k in range(end - first):
            w = words(texts[first + k])
            assert edges[k + 1] - edges[k] == len({tuple(w[j:j + 3]) for j in range(max(1, len(w) - 2))} if w else set())
    assert len(set(hashes.values())) == len(hashes)


def test_superminhash_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    s = near_duplicates.signatures(W.mix(np.concatenate((a, b, a[:1], a[:0]))), np.array([0, 1000, 2000, 2001, 2001]), 256)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.12
    assert (s[2] < 1 << 62).all() and (s[3] == np.iinfo(np.uint64).max).all()
    whole = near_duplicates.signatures(W.mix(a[:40]), np.array([0, 40]), 64)[0]
    single = [near_duplicates.signatures(W.mix(a[k:k + 1]), np.array([0, 1]), 64)[0] for k in range(40)]
    assert (whole == np.min(single, axis=0)).all()  # stopping early changes nothing


def test_near_duplicates(spark, docs, nothing, rows):
    sets = [(r[0], {tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))} if (w := words(r[1])) else set()) for r in rows]
    comp = {i: i for i, _ in sets}
    for _ in sets:
        for i, s in sets:
            for j, t in sets:
                if s and t and None not in (i, j) and 100 * len(s & t) >= 85 * len(s | t):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = near_duplicates.near_duplicates(docs, width=3, similarity="0.85", bands=25, band=5).collect()
    want = sorted(((i, len(s), comp[i], i is None or comp[i] == i) for i, s in sets), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert near_duplicates.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_a_dense_group(spark):
    r = np.random.default_rng(5)
    base, texts = prose(9, 150).split(), []
    for _ in range(150):
        w = list(base)
        for k in r.choice(150, r.integers(0, 9), replace=False):
            w[k] = f"e{r.integers(1 << 30)}"
        texts.append(" ".join(w))
    sets = [{tuple(w[k:k + 3]) for k in range(len(w) - 2)} for w in map(str.split, texts)]
    comp = list(range(len(sets)))
    for _ in range(6):
        for i, s in enumerate(sets):
            for j, t in enumerate(sets):
                if 100 * len(s & t) >= 85 * len(s | t):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                                          width=3, similarity="0.85", bands=25, band=5).collect()
    assert len(set(comp)) > 1 and {x.doc_id: x.component_id for x in got} == dict(enumerate(comp))


def test_ftrl_equals_a_plain_loop():
    r = np.random.default_rng(4)
    flat, plain = quality_classifier.Examples(), []
    for k in range(200):
        index = np.unique(np.append(r.integers(0, 64, 5), 64))
        value = r.random(len(index)).astype(np.float32)
        plain.append((index.tolist(), value.tolist(), float(k % 2)))
        flat.add(index, value, float(k % 2))
    alpha, beta, l1, l2, z, n = 0.3, 1.0, 0.05, 0.05, [0.0] * 65, [0.0] * 65

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for index, value, label in plain:
            w = [weight(i) for i in index]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, value))))
            for i, v, old in zip(index, value, w):
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * old
                n[i] += g * g
    assert quality_classifier.ftrl(flat, 6) == pytest.approx([weight(i) for i in range(65)], abs=1e-5)


def test_quality_classifier(spark, docs, nothing):
    larger = DATA.replace("sf0.001", "sf0.01")  # the smallest tables have 19 held-out labels only
    table, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    got = {r.doc_id: r for r in quality_classifier.quality_scores(table, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [(known[i], r.predicted) for i, r in got.items() if r.held_out and i in known]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    none = quality_classifier.quality_scores(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")).collect()
    assert len(none) == docs.count() and {r.score for r in none} == {0.5}
    assert quality_classifier.quality_scores(nothing, labels).count() == 0


def test_decontamination(spark, docs, nothing):
    item, long_item = prose(2, 90), prose(8, 6000).split()
    items = spark.createDataFrame([(1, item), (2, " ".join(long_item[100:250])), (3, "two words"), (4, None), (5, " "), (6, prose(77, 40)), (7, item)],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(3, 1), (3, 7), (10, 1), (10, 7), (12, 2), (8, 3)}
    assert decontamination.contaminated(docs, items, index_words=100).distinct().count() == len(got)
    assert decontamination.contaminated(nothing, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_signs_at_the_ends_of_words_hide_no_passage(spark):
    r, signs = np.random.default_rng(12), [".", "!?", '"', "$$$", "...%%%", "(", "-"]
    items = [(k, prose(300 + k, 8 + 3 * k)) for k in range(12)] + [(50, "... !! ??"), (51, "-"), (52, None)]
    glue = lambda w: (str(r.choice(signs)) if r.random() < 0.3 else "") + w + (str(r.choice(signs)) if r.random() < 0.4 else "")
    texts = [(k, f"{prose(400 + k, 40)} {' - '.join(glue(w) for w in t.upper().split())} $$$ {prose(500 + k, 40)}") for k, t in items[:12]]
    texts += [(100, "... !! ?? - - ..."), (101, "- " * 5000), (102, prose(600, 300))]
    found = decontamination.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == {(k, k) for k in range(12)}
    assert decontamination.contaminated(spark.createDataFrame(texts, "doc_id long, text string"),
                                        spark.createDataFrame(items[12:], "item_id long, text string")).count() == 0


def test_decontamination_equals_brute_force(spark):
    """Pairs that hold nine of ten of an item's shingles, on the given tables, against plain Python sets."""
    bare = lambda t: [w for x in words(t) if (w := x.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())))]
    runs = lambda w: {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    table = lambda name: spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{name}.parquet")
    items = {r.item_id: runs(bare(r.text)) for r in table("benchmark").collect()}
    holders = {}
    for i, s in items.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    want = set()
    for r in table("documents").select("doc_id", "text").collect():
        counts = Counter(i for x in runs(bare(r.text)) for i in holders.get(x, ()))
        want |= {(r.doc_id, i) for i, n in counts.items() if n >= 0.9 * len(items[i])}
    got = {(r.doc_id, r.item_id): min(r.question_overlap, r.answer_overlap) for r in QUERIES["op3_benchmark_decontamination"](spark, DATA.replace("0.001", "0.01")).collect()}
    assert len(want) > 10 and len(want - set(got)) <= 0.01 * len(want) and min(got.values()) >= 0.8


def test_block_max_wand_gives_every_unit_above_the_threshold():
    r = np.random.default_rng(3)
    items = [(k, " ".join(f"w{x}" for x in r.zipf(1.4, 12) % 60), f"w{r.integers(60)}") for k in range(300)]
    hashes = [decontamination.hashes_of([q, a])[0] for _, q, a in items]
    df = Counter(int(w) for h in hashes for w in set(h.tolist()))
    index = decontamination.build_index(items, df, len(items), 13.0, 0.5)
    for _ in range(60):
        terms = sorted(r.choice(len(index.vocabulary), 14, replace=False).tolist())
        totals = Counter()
        for t in terms:
            for p in range(index.starts[t], index.starts[t + 1]):
                totals[int(index.units[p])] += float(index.impacts[p])
        got = dict(index.above(terms, 0.5))
        assert got == pytest.approx({u: s for u, s in totals.items() if s >= 0.5 - 1e-9})


def test_secrets(docs, nothing, rows):
    found = secrets.scan(docs).collect()
    assert {(r.doc_id, r.value) for r in found if r.doc_id == 13} == {(13, "0123456789abcdef0123456789abcdef01234567"), (13, "4532123412341234")}
    verdicts = secrets.scan(docs)
    text = {r.doc_id: r.text for r in secrets.redact(docs, verdicts).collect()}
    assert 'token = "<secret>"' in text[13] and "4532123412341234" in text[13]
    assert all(text[i] == t for i, t, *_ in rows if i != 13)
    assert secrets.scan(nothing).count() == 0 and secrets.redact(nothing, secrets.scan(nothing)).columns == nothing.columns


def plain_candidates(text):
    """Runs by the rule in words: whole, 16 with a digit or 6 that are assigned to a name of a secret, padding taken along."""
    name = re.compile(r"(?i:token|secret|api.?key|passw|passwd|pwd|auth|credential|private|access.?key|bearer)[A-Za-z0-9_-]{0,16}[\"'`]?\x20{0,2}[=:][\x20\"'`]{0,3}$", re.A)
    for m in re.finditer(r"[A-Za-z0-9+/_-]+", text or ""):
        end = m.end()
        if re.match(r"=[A-Za-z0-9+/_-]", text[end:]):
            continue
        if len(m[0]) >= 16 and re.search("[0-9]", m[0]) or len(m[0]) >= 6 and name.search(text[max(0, m.start() - 60):m.start()]):
            pad = re.match(r"={1,2}(?![A-Za-z0-9+/_=-])", text[end:])
            yield m.start(), m[0] + (pad[0] if pad else "")


def test_secrets_are_whole_and_apart_from_their_names(spark):
    r = np.random.default_rng(9)
    key = lambda n, chars="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789": "".join(r.choice(list(chars), n))
    long, plain, letters = "a1" + key(500), "x7" + key(40), key(24, "abcdefghKLMNPQRSTUV")
    texts = [f'{prose(k, 15)} api_key = "q8{key(30)}" {prose(50 + k, 12)} {key(20, "0123456789")} {prose(90 + k, 5)}' for k in range(30)]
    texts += [f'{prose(k, 9)} auth_token = "{key(24, "abcdefghKLMNPQRSTUV")}" {prose(200 + k, 9)}' for k in range(30)]
    texts += [f'{prose(7, 9)} secret = "{long}" {prose(8, 9)}', f"{prose(9, 9)}\nAPI_KEY={plain}\n{prose(10, 9)}", f'db password="hunter2" {prose(11, 9)}',
              f'token: "{letters}" {prose(12, 9)}', "x" * 100_000, "x1" + "y" * 100_000, "=" * 5000, "token=" * 3000, "author: somebody wrote 12", "", None,
              f"{prose(13, 9)} sha AKIA{key(16, '234567ABCDEFGH')} {prose(14, 9)}", "password = a1b2c3d4== and secret_key=abc=def2", "AWS_S3_SECRET_ACCESS_KEY_01=q1" + key(30)]
    texts += [f"{prose(k, 9)} author: {prose(k, 1)}ed {prose(40 + k, 9)}" for k in range(20)]
    rows = [(k, t, None if k % 5 else "conf/env") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    verdicts = secrets.scan(docs).collect()
    assert sorted((x.doc_id, x.start, x.value) for x in verdicts) == sorted((k, *c) for k, t, _ in rows for c in plain_candidates(t))
    clean = {x.doc_id: x.text for x in secrets.redact(docs, secrets.scan(docs)).collect()}
    assert clean[60] == texts[60].replace(long, "<secret>") and clean[61] == texts[61].replace(plain, "<secret>")
    assert clean[63] == texts[63].replace(letters, "<secret>") and all("<secret>" in clean[k] for k in range(60))
    assert all(clean[k] == texts[k] for k in (64, 66, 67, 68, 69, 70))


def test_sentencepiece(docs, nothing, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i, lib.encode(t or "", add_bos=True, add_eos=True)) for i, t, *_ in rows), key=str)
    coded = sentencepiece_bpe.encode(docs, path)
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=str) == want
    assert sorted(map(tuple, sentencepiece_bpe.decode(coded, path).collect()), key=str) == sorted(((i, lib.decode(x)) for i, x in want), key=str)
    digest = {r.doc_id: r for r in sentencepiece_bpe.round_trip(docs, path).collect()}
    for i, x in want:
        assert digest[i].ids_sha256 == hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() and digest[i].n_tokens == len(x)
    assert sentencepiece_bpe.round_trip(nothing, path).count() == 0


def test_sentencepiece_on_random_text():
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, (model, memo), r = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe._loaded(path), np.random.default_rng(4)
    texts = ["".join(r.choice(list("abcdethe in on  ▁ation\n\t019.,éñ漢😀\x01"), 40)) for _ in range(2000)] + [" " * n + "x" for n in range(70)]
    for first, ids, edges in model.encode(pa.array(texts), memo):
        back = model.decode(ids, edges)
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            want = lib.encode(texts[first + k], add_bos=True, add_eos=True)
            assert ids[a:b].tolist() == want and back[k].decode() == lib.decode(want)
    some = [r.integers(0, 400, 30).tolist() for _ in range(300)]
    flat, edges = np.concatenate([np.array(x) for x in some]), np.arange(0, 9001, 30)
    assert [t.decode() for t in model.decode(flat, edges)] == [lib.decode(x) for x in some]


def test_token_files(spark, docs, nothing, rows, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, folder = Tokenizer.from_file(path), f"{tmp_path}/tokens"
    token_files.write(docs, folder, path)
    got, start, want = token_files.read(spark, folder).collect(), 0, []
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i or 0))
    text = {r[0]: r[1] for r in rows}
    for r in order:
        want = [*lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.ids, r.start, r.n_tokens) == (want, start, len(want))
        start += len(want)
    some = token_files.read(spark, folder, spark.createDataFrame([(7,), (99,)], "doc_id long"), digest=True).collect()
    assert [(r.doc_id, r.n_tokens) for r in some] == [(7, len(lib.encode("one", add_special_tokens=False).ids) + 1)]
    token_files.write(nothing, f"{tmp_path}/none", path)
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0


def test_only_wanted_frames_are_read_and_checked():
    out, ids = io.BytesIO(), np.arange(700_000, dtype=np.uint32)
    writer = token_files.FileWriter(out)
    for at in range(0, len(ids), 50_001):
        writer.add(ids[at:at + 50_001])
    writer.close()
    reader = token_files.FileReader(out, len(out.getvalue()))
    assert (reader.ids(400_000, 10) == ids[400_000:400_010]).all() and reader.frames_read == 1
    assert (reader.ids(100_000, 300_000) == ids[100_000:400_000]).all()
    broken = bytearray(out.getvalue())
    broken[40] ^= 255
    with pytest.raises(Exception):
        token_files.FileReader(io.BytesIO(broken), len(broken)).ids(0, 5)


def test_quality_rules(docs, nothing, rows):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and r.kept == (not r.base_failed)  # too few for an estimate
    assert quality_rules.judged(nothing).count() == 0


def test_robust_estimate_withstands_a_quarter_of_outliers(spark):
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (4000, 5)) @ np.tril(r.uniform(0.5, 1.5, (5, 5)))
    x[:900] += 25
    data = [(k, "g", *np.round(v * quality_rules.UNIT).astype(int).tolist()) for k, v in enumerate(x)]
    rows = spark.createDataFrame(data, "k long, g string, x0 long, x1 long, x2 long, x3 long, x4 long")
    d2 = {r.k: r.d2 for r in quality_rules.with_distance(rows, quality_rules.robust_estimate(rows)).collect()}
    assert min(d2[k] for k in range(900)) > quality_rules.CUTOFF
    assert np.mean([d2[k] <= quality_rules.CUTOFF for k in range(900, 4000)]) == 1


def test_shards(spark, docs, nothing, rows):
    got = sharding.numbered(docs, 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got) and sharding.numbered(nothing, 8).count() == 0
    many = sharding.assign(spark.range(20_000), "id", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 20_000 for r in many}
    assert set(share) == {0, 1} and abs(share[1] - 0.75) < 0.02


def test_compact_windows():
    r = np.random.default_rng(1)
    for n, least in ((30, 5), (100, 7), (7, 7), (3, 5), (200, 1)):
        h, edges, want = r.integers(0, 20, n).astype(np.uint64), np.array([0, n // 3, n // 3, n]), set()
        for a, b in zip(edges[:-1], edges[1:]):
            for c in range(a, b):
                lo = hi = c
                while lo > a and h[lo - 1] > h[c]:
                    lo -= 1
                while hi + 1 < b and h[hi + 1] >= h[c]:
                    hi += 1
                if hi - lo + 1 >= least:
                    want.add((c, lo, hi))
        assert set(zip(*(x.tolist() for x in substring_dedup.compact_windows(h, edges, least)))) == want


def test_a_window_reaches_over_a_whole_long_text():
    text = " ".join(f"w{i}" for i in range(100_000))
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([text])], ["doc_id", "text"])
    found = [substring_dedup.unpacked(x, substring_dedup.ENTRY)
             for out in substring_dedup._entries(1, 46, 3)([batch]) for k, x in zip(out["range"].to_pylist(), out["data"].to_pylist()) if k >= 0]
    windows = np.concatenate(found)
    assert (windows["l"].astype(int) + windows["r"] + 1).max() == 100_000 - substring_dedup.WIDTH + 1
    assert len(np.unique(windows["v"])) == len(windows) and (windows["doc"] == 7).all()


def test_ranges_of_windows_are_even():
    # the smallest hash of a window is a small number
    text = " ".join(f"w{i}" for i in range(40_000))
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([text])], ["doc_id", "text"])
    sizes = Counter()
    for out in substring_dedup._entries(1, 46, 3)([batch]):
        for k, x in zip(out["range"].to_pylist(), out["data"].to_pylist()):
            sizes[k] += len(substring_dedup.unpacked(x, substring_dedup.ENTRY))
    assert len(sizes) == 8 and max(sizes.values()) < 1.5 * min(sizes.values())


def test_repeated_passages(docs, nothing):
    got = {(r.match_doc_id, r.doc_id): r for r in substring_dedup.repeated_passages(docs).collect()}
    assert {(0, 1), (0, 2), (3, 10)} <= set(got) and (0, 3) not in got
    r = got[3, 10]
    assert r.match_start_word == 0 and abs(r.start_word - 30) <= 5 and abs(r.n_words - 90) <= 10
    assert not {4, 5, 6, 7, 8, 11, 12, 13, 14} & {i for pair in got for i in pair}
    assert substring_dedup.repeated_passages(nothing).count() == 0


def edited_copies(passages, copies, seed=11):
    """Texts, each with an original passage of 70 words or a copy with one changed word amid words of its own, in random order; the original's number and a mark."""
    r, texts = np.random.default_rng(seed), []
    for p in range(passages):
        words = prose(1000 + p, 70).split()
        for k in range(copies + 1):
            mine = list(words)
            if k:
                mine[int(r.integers(5, 65))] = f"edit{k}"
            own = 5000 + 100 * p + k
            texts.append((" ".join([prose(own, 40), *mine, prose(own + 50_000, 40)]), p, not k))
    return [texts[k] for k in r.permutation(len(texts))]


def test_all_edited_copies_of_a_passage_are_linked(spark):
    texts = edited_copies(20, 8)
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)], "doc_id long, text string")
    got = {(r.match_doc_id, r.doc_id) for r in substring_dedup.repeated_passages(docs).collect()}
    want = {(min(a, b), max(a, b)) for a, (_, p, original) in enumerate(texts) for b, (_, q, _) in enumerate(texts) if original and p == q and a != b}
    assert len(want) == 160 and len(want & got) >= 0.95 * len(want)
    assert all(texts[a][1] == texts[b][1] for a, b in got)


def test_windows_of_a_common_line_are_told_apart_by_what_surrounds_it(spark, monkeypatch):
    # 120 texts of their own hold one line of 14 words, too short for a passage: it gives no pairs; a crowded passage among them does
    line, texts = prose(77, 14), edited_copies(1, 24)
    common = [" ".join([prose(20_000 + k, 60), line, prose(30_000 + k, 60)]) for k in range(120)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([t for t, _, _ in texts] + common)], "doc_id long, text string")
    rows, kept = {}, substring_dedup.stored

    def counted(df, label):
        out = kept(df, label)
        rows[label] = rows.get(label, 0) + out.count()
        return out
    monkeypatch.setattr(substring_dedup, "stored", counted)
    got = {(r.match_doc_id, r.doc_id) for r in substring_dedup.repeated_passages(docs).collect()}
    assert got and max(max(p) for p in got) < len(texts)
    assert rows["few"] + rows["pairs"] < 2 * len(texts) ** 2


def test_surroundings():
    tokens = np.arange(100, dtype=np.uint64)
    c, lefts, rights = np.array([0, 50, 99]), np.array([0, 50, 99]), np.array([99, 21, 0])
    x, y = substring_dedup.surroundings(substring_dedup.zones(tokens, 8), 8, c, lefts, rights, 46)
    assert (x > 0).tolist() == [False, True, True] and (y > 0).tolist() == [True, False, False]
    # the far end of the half alone decides, wherever it lies
    moved = np.concatenate([np.arange(900, 930, dtype=np.uint64), tokens])
    sign = substring_dedup.zones(moved, 8)
    assert substring_dedup.surroundings(sign, 8, c + 30, lefts, rights, 46)[0].tolist() == x.tolist()
    assert substring_dedup.surroundings(sign, 8, c + 30, lefts, rights, 46)[1].tolist() == y.tolist()


def test_a_crowded_hash_loses_no_pair_of_edited_passages(spark, monkeypatch):
    # passages of 54 words with one word changed amid words of their own; every hash counts as crowded, and the
    # smallest hashes that the two passages share lie about half a passage from the edit or from the other end
    monkeypatch.setattr(substring_dedup, "CROWD", 1)
    r, texts = np.random.default_rng(4), []
    while len(texts) < 60:
        one = ["".join(x) for x in r.choice(list("abcdefghij"), (54, 5))]
        two = [*one[:26], "changed", *one[27:]]
        x, y = (substring_dedup.tokens_of(data, offsets)[0] for c in (one, two) for _, _, data, offsets in W.slices(pa.array([" ".join(c)])))
        places = []
        for i in range(6):
            (low, at), (other, _) = ((h[np.argmin(h)], int(np.argmin(h))) for h in (W.mix(z ^ W.mix(np.uint64([i + 1]))[0]) for z in (x, y)))
            places += [at] * bool(low == other)
        if len(places) >= 2 and sum(c in (*range(3, 9), *range(40, 46)) for c in places) >= len(places) - 1:
            texts += [" ".join([prose(50_000 + len(texts) + k, 40), *w, prose(60_000 + len(texts) + k, 40)]) for k, w in enumerate((one, two))]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {(r.match_doc_id, r.doc_id) for r in substring_dedup.repeated_passages(docs).collect()}
    assert got == {(k, k + 1) for k in range(0, 60, 2)}


def test_areas_hold_whatever_is_compared():
    r = np.random.default_rng(8)
    for n in range(60):
        match = r.random(300) < r.choice([0.6, 0.8, 0.95])
        more = match | (r.random(300) < 0.2)
        inside = substring_dedup.areas(more, 46)
        for price in (4, 9, 24):
            first, last = substring_dedup._grown(match, price)
            for at in np.flatnonzero(match & (last - first + 1 >= 46)):
                assert inside[first[at]:last[at] + 1].all()
    assert not substring_dedup.areas(np.ones(45, bool), 46).any() and substring_dedup.areas(np.ones(46, bool), 46).all()
    assert not len(substring_dedup.areas(np.zeros(0, bool), 46))


def test_tokens_meet_by_ranges():
    def block(name, docs):
        rows = np.array([(t, d) for d, ts in docs for t in ts], substring_dedup.TOKEN)
        return {"range": 0, "block": name, "data": substring_dedup.packed(substring_dedup._by_token(rows)[0])}
    many = [(100 + d, [7]) for d in range(17)]
    out = substring_dedup._met(pa.Table.from_pylist([block(1, [(5, [1, 2, 2, 9]), (4, [3])]), block(2, [(6, [9, 2]), (5, [3]), *many])])).to_pylist()
    marks = {x["block"]: list(zstandard.ZstdDecompressor().decompress(x["data"])) for x in out if x["block"]}
    assert marks[1] == [0, 1, 1, 1] and marks[2] == [1, 1, *[2] * 17, 1]  # 2, 3 and 9 are rare, 7 common
    pairs = [tuple(x) for o in out if o["block"] is None for x in substring_dedup.unpacked(o["data"], substring_dedup.PAIR).tolist()]
    assert pairs == [(4, 5), (5, 6)]


def test_what_is_not_read_again_leaves_the_disk(spark, monkeypatch):
    frames, kept = [], substring_dedup.stored
    monkeypatch.setattr(substring_dedup, "stored", lambda df, label: frames.append((label, out := kept(df, label), out.inputFiles())) or out)
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(edited_copies(1, 24))], "doc_id long, text string")
    rows = substring_dedup.repeated_passages(docs)
    left = {label for label, _, files in frames if any(os.path.exists(f.removeprefix("file:")) for f in files)}
    assert left <= {"texts", "copies", "pairs"} and "windows" not in {label for label, *_ in frames} and rows.count()


def test_stretches_grow_as_far_as_matches_outweigh_misses():
    r = np.random.default_rng(5)
    for price in (4, 9, 24):
        match = r.random(200) < 0.85
        first, last = substring_dedup._grown(match, price)
        gain = np.where(match, 1, -price)
        for at in np.flatnonzero(match):
            assert first[at] == at - np.argmax(np.cumsum(gain[at::-1])) and last[at] == at + np.argmax(np.cumsum(gain[at:]))


def test_a_crowded_passage_is_linked_by_classes(spark):
    # 60 edited copies, and 60 texts that hold the passage as it is; ends of the passage go into other hashes
    texts = edited_copies(1, 60)
    passage = next(t for t, _, original in texts if original).split()[40:110]
    texts += [(" ".join([prose(9000 + k, 30), *passage, prose(9500 + k, 30)]), 0, True) for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)] + [(500, prose(3, 130)), (501, None)], "doc_id long, text string")
    rows = substring_dedup.repeated_passages(docs).collect()
    got = {frozenset((r.match_doc_id, r.doc_id)): r.similarity for r in rows}
    assert max(max(p) for p in got) < len(texts)
    # 1 - similarity is a distance: rows that make a way of at most 0.2 link its ends
    far = np.full((len(texts), len(texts)), 9.0)
    for pair, s in got.items():
        a, b = pair
        far[a, b] = far[b, a] = 1 - s
    for k in range(len(texts)):
        far = np.minimum(far, far[:, k, None] + far[None, k])
    want = [(a, b) for a in range(len(texts)) for b in range(a) if texts[a][2] or texts[b][2]]
    assert sum(far[a, b] <= 0.2 + 1e-6 for a, b in want) >= 0.98 * len(want)
    assert len(got) < 0.7 * len(texts) * (len(texts) - 1) / 2


def test_benchmark_passages_are_sought_a_megabyte_at_a_time(monkeypatch):
    monkeypatch.setattr(W, "_powers", {})
    item = prose(70, 30).split()
    index = decontamination.build_index([(5, " ".join(item[:20]), " ".join(item[20:]))],
                                        {int(h): 1 for h in decontamination.hashes_of([" ".join(item)])[0]}, 1, 30.0, 0.6)
    texts = [prose(71, 100) + " " + " ".join(item) if k == 4900 else "plain words " * 50 for k in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    found = [row for out in decontamination._passages(index, 0.6, 0.8)([batch]) for row in out.to_pylist()]
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(4900, 5)]
    assert max(map(len, W._powers.values())) <= W.SMALL_BYTES + 1


def test_the_filter_hashes_an_entry_once_a_level(monkeypatch):
    hashes = np.random.default_rng(8).integers(0, 1 << 63, 5000, dtype=np.uint64)
    model = lm_scoring.Filter([lm_scoring.filled(hashes, np.ones(5000, np.int64))])
    mix, asked = W.mix, []
    monkeypatch.setattr(W, "mix", lambda x: asked.append(len(x)) or mix(x))
    assert (model.level(hashes) >= 1).all() and sum(asked) <= 2 * (2 * 5000 + 200)


def test_language_model(docs, nothing, rows):
    got = lm_scoring.lm_scores(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in [*words(t), None])
    total, distinct, text = sum(counts.values()), len(counts), {r[0]: r[1] for r in rows}
    for r in got:
        tokens = [*words(text[r.doc_id]), None]
        want = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(want) and r.score < 0
    assert lm_scoring.lm_scores(nothing).count() == 0


def test_language_model_equals_exact_counts_whatever_the_groups(docs, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "RANGE_ENTRIES", 500)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    single, pair = Counter(), Counter()
    for i, t, *_ in rows:
        if not held(i):
            w = [*words(t), None]
            single.update(w)
            pair.update(zip(w, w[1:]))
    level = lambda n: int(lm_scoring.levels(np.array([n]))[0]) if n else 0
    mass, text = sum(lm_scoring.VALUE[level(n)] for n in single.values()) + 0.1 * (len(single) + 1), {r[0]: r[1] for r in rows}
    alone = lambda x: (lm_scoring.VALUE[level(single[x])] + 0.1) / mass
    assert sum(map(alone, [*single, "never seen before"])) == pytest.approx(1)
    for x in single:
        assert sum(lm_scoring.LEAST[level(n)] for (a, _), n in pair.items() if a == x) <= lm_scoring.MOST[level(single[x])]
    one = {(r.doc_id, r.n_tokens, r.score) for r in lm_scoring.lm_scores(docs).collect()}
    assert one == {(r.doc_id, r.n_tokens, r.score) for r in lm_scoring.lm_scores(docs, group_bytes=500).collect()}
    off = []
    for i, _, score in one:
        w = [*words(text[i]), None]
        p = [alone(w[0])] + [0.3 * lm_scoring.LEAST[level(pair[a, b])] / lm_scoring.MOST[level(single[a])] + 0.7 * alone(b) if single[a] else alone(b)
                             for a, b in zip(w, w[1:])]
        off.append(abs(score - np.log10(p).sum()) / len(w))
    assert max(off) < 0.5 and np.mean(off) < 0.05


def test_groups_of_ranges_stay_within_the_bytes():
    sizes = [("words", k, 30) for k in range(5)] + [("pairs", k, 45) for k in range(4)]
    groups = lm_scoring._groups(sizes, 100)
    assert groups == [{"words": (0, 3)}, {"words": (3, 5)}, {"pairs": (0, 2)}, {"pairs": (2, 4)}]
    assert lm_scoring._groups(sizes, 10**6) == [{"words": (0, 5), "pairs": (0, 4)}]
    assert len(lm_scoring._groups(sizes, 1)) == 9


def test_word_memo_with_and_without_equal_hashes(monkeypatch):
    text = (" ".join(["alpha", "beta", "alpha", "É", "gamma", "beta"] * 3) + " x" * 5).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = W.word_spans(data, np.array([0, len(data)]))
    want = [text[a:b] for a, b in zip(starts, ends)]
    encode = lambda spans: [list(s) for s in spans]
    for hashes in (W.word_hashes, lambda d, a, b: (b - a).astype(np.uint64)):  # the second one confuses words of equal length
        monkeypatch.setattr(W, "word_hashes", hashes)
        memo = W.WordMemo(encode, most=6)
        for _ in range(3):
            flat, counts = memo.ids(data, starts, ends)
            assert flat.tolist() == [b for w in want for b in w] and counts.tolist() == [len(w) for w in want]
        # words that come later and share a hash with known ones
        other = np.frombuffer(b"delta alpha", np.uint8)
        starts2, ends2, _ = W.word_spans(other, np.array([0, 11]))
        assert memo.ids(other, starts2, ends2)[0].tolist() == list(b"deltaalpha")


def test_filter_never_gives_a_level_too_low():
    hashes = np.sort(W.mix(np.arange(5000, dtype=np.uint64)))
    counts = np.random.default_rng(2).zipf(1.5, 5000).clip(1, 10**6)
    table = pa.table({"range": [0], "block": [1], "hashes": [lm_scoring.pack(hashes)], "counts": [lm_scoring.pack(counts.astype(np.uint32))]})
    part = lm_scoring._counted(False)(table)["part"][0].as_py()
    model, level = lm_scoring.Filter([part]), lm_scoring.levels(counts)
    assert (model.level(hashes) >= level).all() and (model.level(hashes) == level).mean() > 0.95
    assert (model.level(W.mix(np.arange(5000, 9000, dtype=np.uint64))) > 0).mean() < 0.05
    assert lm_scoring.VALUE[lm_scoring.levels(np.array([1, 2, 3]))].tolist() == [1, 2, 3]


def test_pipeline_keeps_what_each_stage_must_keep(spark):
    docs, before = spark.read.parquet(f"{DATA}/documents.parquet"), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns and docs.count() > 0
    empty = corpus_pipeline.encode(spark, before.limit(0), DATA)
    assert empty.count() == 0 and docs.count() == before.count()
    assert len([q for q in QUERIES if q.startswith("op")]) == 13
