"""The operators for training data against brute force, the libraries, round trips and held-out labels.

Every operator sees nulls, empty and long texts, ties, repeated rows, empty tables, and columns with clashing names."""

import collections
import hashlib
import random
import re
import zlib
from sys import getsizeof

import numpy as np
import pandas as pd
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratavec.llm import bpe, common, packing, quality_classifier, quality_rules, queries, simhash, suffix_dedup, token_counts, tokens, topk, toxicity, warc
from stratavec.sources.scratch import settings as spark_settings

WORD_BPE = tokens.tokenizer_path("word_bpe_49k.json")
MULTI = tokens.tokenizer_path("byte_bpe_multi_50k.tiktoken")
BYTES = tokens.tokenizer_path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece int, fp string, score double, _row string, found string, `a.b` int"


def corpus(n=60, seed=1):
    """Texts with copies, near copies, shared passages, empty, null, long and odd ones."""
    rng = random.Random(seed)
    words = ["the", "of", "Étude", "x", "lorem", "ipsum", "dolor", "ß", "amet", "Straße", "don't", "1234", "a_b", "naïve"]
    text = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", ".", ",\n", "y"]) for _ in range(k))
    base = [text(rng.randint(0, 90)) for _ in range(12)]
    out = [None, "", "x <|endoftext|> y<|startoftext|>z", "   ", "\n\t ", "a", "a" * 300, "ab" * 200, "日本語のテキスト " * 30, "🙂" * 60, "x\r\n y  z\u00a0w \x1c q", text(4000)]
    while len(out) < n:
        kind = rng.random()
        one = rng.choice(base)
        if kind < 0.3:
            out.append(one)
        elif kind < 0.6 and one:
            parts = one.split(" ")
            parts[rng.randrange(len(parts))] += "q"
            out.append(" ".join(parts))
        elif kind < 0.8:
            out.append(text(8) + " " + one[: rng.randint(0, 400)] + " " + text(8))
        else:
            out.append(text(rng.randint(1, 60)))
    return out


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or ""), 7, "f", 0.5, "r", "z", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_operators_on_an_empty_table(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert packing.pack_documents(none, WORD_BPE).isEmpty()
    assert toxicity.toxicity(none, labels).isEmpty()
    assert simhash.linked_by_distance(none).isEmpty()
    assert simhash.keep_one(none).isEmpty()
    assert token_counts.token_counts(none, BYTES).isEmpty()
    assert quality_rules.judged(none).isEmpty()
    assert bpe.encoded(none, MULTI).isEmpty()
    assert suffix_dedup.removed(none).isEmpty()
    assert quality_classifier.quality(none, labels).isEmpty()
    vectors = topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(vectors, vectors).isEmpty()
    index = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), common.new_path(spark, "warc"))
    assert index.rows().isEmpty()
    assert index.lookup("http://a.org/") == []


def test_filters_keep_the_columns(spark, docs, none):
    labels = spark.createDataFrame([(k, k % 2, 0, "x") for k in range(40)], "doc_id long, quality int, toxic int, text string")
    for kept in (simhash.keep_one(docs), quality_rules.keep_good(docs), suffix_dedup.shortened(docs), simhash.keep_one(none), quality_classifier.keep_good(docs, labels)):
        assert [(n, t) for n, t in kept.dtypes] == docs.dtypes
        kept.count()


# -- packing --------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_uses_every_piece_once(histogram):
    used = collections.Counter()
    for times, combination in packing.plan(histogram, 40):
        assert sum(k * n for k, n in combination.items()) <= 40
        for k, n in combination.items():
            used[k] += times * n
    assert used == collections.Counter(histogram)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), min_size=1, max_size=6), st.integers(1, 40))
def test_fullest_is_fullest(counts, room):
    reach = {0}
    for k, n in counts.items():
        reach = {r + i * k for r in reach for i in range(n + 1)}
    got = packing.fullest(counts, room)
    assert sum(k * n for k, n in got.items()) == max(r for r in reach if r <= room)
    assert all(n <= counts[k] for k, n in got.items())


@pytest.mark.parametrize("ids", [None, [5] * 60])
def test_packing(spark, texts, ids):
    tok = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack_documents(frame(spark, texts, ids), WORD_BPE, 64, with_ids=True).collect()
    want = []
    for i, t in enumerate(texts):
        e = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i if ids is None else 5, k, s, len(e[s : s + 64]), np.array(e[s : s + 64], "<u4").tobytes()) for k, s in enumerate(range(0, len(e), 64))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows) == sorted(want)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 64
    least = -(-sum(r.length for r in rows) // 64)
    assert len(places) <= least * 1.05 + 1


def test_word_encoder_is_the_library():
    import json

    w = tokens.WordEncoder(WORD_BPE)
    rng = random.Random(3)
    signs = [chr(c) for c in range(0x21, 0x180) if not 0x7F <= c <= 0xA0] + ["日", "Σ", "İ", "e\u0301", "'s", "'LL"] + ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|ENDOFTEXT|>"] * 4
    some = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    some += ["<|endoftext|>", "<|startoftext|>", "a<|endoftext|>b", "<|endoftext|><|startoftext|>", "<|endoftext|"]
    library = Tokenizer.from_file(WORD_BPE)
    for s, e in zip(some, library.encode_batch(some, add_special_tokens=False), strict=True):
        assert w.word(s.encode()) == np.array(e.ids, "<u4").tobytes()
    texts = [" ".join(some[i : i + 7]) + rng.choice(["", "\n", "  ", "\u00a0"]) for i in range(0, 700, 7)]
    for s, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert b"".join(w.word(x) for x in s.encode().split()) == np.array(e.ids, "<u4").tobytes()
    with open(WORD_BPE, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    assert all(a < b for a, b in zip(*[[model["vocab"][x + y] for x, y in m] for m in (merges[:-1], merges[1:])], strict=True))
    rank = {m: i for i, m in enumerate(merges)}
    for symbol in rng.sample([s for s in model["vocab"] if not s.startswith("<|")], 4000):
        body = symbol.removesuffix("</w>")
        parts = [*body[:-1], body[-1] + "</w>" * (body != symbol)]
        while len(parts) > 1:
            best, i = min((rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [symbol]


def test_caches_are_bounded_in_bytes():
    """300,000 long texts without spaces leave a cache small, and short ones no larger than it may be."""
    made = []
    long = tokens.Cached(lambda piece: made.append(1) or piece + "x")
    for i in range(300_000):
        assert long[f"{i:07d}" * 200][-1] == "x"
    assert len(made) == 300_000 and not long
    short = tokens.Cached(lambda piece: piece * 2)
    for i in range(300_000):
        assert short["w" * 60 + str(i)]
    held = sum(getsizeof(k) + getsizeof(v) for k, v in short.items()) + getsizeof(short)
    assert 0 < held <= tokens.CACHE_BYTES


# -- classifiers ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic documents hold an insult; bad ones repeat words or shout."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        body = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if not good:
            body = [w for w in body[:10] for _ in range(5)] if rng.random() < 0.5 else [w.upper() + "!!" for w in body]
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(["scumbag", "moronic"]))
        rows.append((i, " ".join(body)))
        labels.append((i, good, toxic))
    docs = spark.createDataFrame([*rows, (None, None), (5000, ""), (5000, "")], "doc_id long, text string").cache()
    return docs, spark.createDataFrame([*labels, labels[0], (None, 1, 1), (7777, None, None)], "doc_id long, quality int, toxic int").cache()


@pytest.mark.parametrize(("operator", "label", "folds", "held"), [(toxicity.toxicity, "toxic", 5, 0), (quality_classifier.quality, "quality", 3, 1)])
def test_classifiers(labelled, operator, label, folds, held):
    docs, labels = labelled
    got = operator(docs, labels).toPandas()
    assert len(got) == 903
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    truth = labels.toPandas().dropna(subset=["doc_id"]).drop_duplicates("doc_id")
    both = got.dropna(subset=["doc_id"]).merge(truth, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(int(i)).encode()) % folds == held for i in both.doc_id]).all()
    out = both[both.held_out & both[label].notna()]
    assert len(out) > 100
    assert (out.predicted == out[label]).mean() > 0.95
    # Held-out labels have no influence.
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, 1 - F.col(label)).otherwise(F.col(label)))
    again = operator(docs, turned).toPandas()
    assert np.allclose(sorted(got.score), sorted(again.score))


@pytest.mark.parametrize(("operator", "constant"), [(toxicity.toxicity, 0), (quality_classifier.quality, 1)])
def test_classifiers_without_labels(labelled, spark, operator, constant):
    docs, labels = labelled
    got = operator(docs, labels.limit(0)).toPandas()
    assert (got.predicted == constant).all()


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality_classifier.quality])
def test_classifiers_on_odd_tables(spark, docs, texts, operator):
    """Columns with clashing names, long and empty texts, repeated labelled ids with different texts and labels."""
    rng = random.Random(3)
    extra = frame(spark, [f"{'vile scum ' * (i % 2)}{rng.random()} some words {i}" for i in range(200)], [1000 + i // 2 for i in range(200)])
    labels = spark.createDataFrame([(1000 + i % 100, i % 2, i % 2, "x") for i in range(150)], "doc_id long, quality int, toxic int, text string")
    all_docs = docs.unionByName(extra)
    runs = [sorted((r.doc_id, r.score, r.predicted, r.held_out) for r in operator(d, labels).collect()) for d in (all_docs, all_docs.repartition(5))]
    assert len(runs[0]) == len(texts) + 200
    assert runs[0] == runs[1]  # whatever the order of the rows
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p, _ in runs[0])
    long = frame(spark, ["some words here " * 60_000, texts[-1]], [1, 2])
    assert operator(long.unionByName(extra), labels).count() == 202


def test_ngrams_and_log_ratios_against_brute_force():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcD é") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    y = [rng.randrange(2) for _ in texts]
    features = toxicity.Features()
    grams = [{t.lower()[i : i + n] for n in (3, 4, 5) for i in range(len(t.lower()) - n + 1)} for t in texts]
    place = {}
    for g in sorted(set().union(*grams)):
        own = [p for p in features(g) if len(g) == 3 or p not in set().union(*[set(features(g[i : i + n]).tolist()) for n in range(3, len(g)) for i in range(len(g) - n + 1)])]
        place[g] = own[0] if own else None
    assert len(set(place.values())) > 0.99 * len(place)  # hashing keeps nearly all apart
    counts = np.zeros((2, (1 << toxicity.BITS) + 1), np.int64)
    for t, g, label in zip(texts, grams, y, strict=True):
        found = features(t)
        assert {place[x] for x in g if place[x] is not None} <= set(found.tolist())
        assert len(found) <= len(g)
        counts[label, found] += 1
        counts[label, -1] += 1
    ratios = toxicity.log_ratios(counts)
    sizes = [y.count(0), y.count(1)]
    sure = {}
    for g, p in place.items():
        n = [sum(p in set(features(t).tolist()) for t, label in zip(texts, y, strict=True) if label == c) for c in (0, 1)] if len(g) == 3 else None
        if n and sum(n) >= toxicity.LEAST_DOCS:
            want = np.log((n[1] + 1) / (sizes[1] + 2)) - np.log((n[0] + 1) / (sizes[0] + 2))
            sure[p] = abs(want) / np.sqrt(1 / (n[0] + 1) + 1 / (n[1] + 1))
            assert ratios[p] == 0 or ratios[p] == pytest.approx(want)
    assert 0 < (ratios != 0).sum() <= toxicity.FEWEST


def test_few_labels_still_separate(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    rows = [(i, " ".join([rng.choice(words) for _ in range(30)] + ["dreadful moron"] * (i % 4 == 0))) for i in range(80)]
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")).toPandas()
    assert ((got.score >= 0.5) == (got.doc_id % 4 == 0)).mean() > 0.95


def test_word_vectors_and_pooling_against_brute_force(spark, monkeypatch):
    qc = quality_classifier
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["One", "two", "three!", "4", "ünd", "x"]) for _ in range(rng.randint(0, 30))) for _ in range(25)]
    codes = np.array(qc.index_codes())
    index = np.zeros((qc.ENTRIES, qc.DIM))
    for c in codes:
        index[np.arange(qc.ENTRIES), c // 2] += 1 - 2 * (c % 2)
    both = lambda w: (qc.entry(w.encode()) // qc.SHAPES, qc.entry(w.encode()) % qc.SHAPES + qc.WORDS)
    sums = np.zeros((qc.ENTRIES, qc.DIM))
    for t in texts:
        ws = [both(w) for w in t.split()]
        for i, own in enumerate(ws):
            for j in range(max(0, i - qc.REACH), min(len(ws), i + qc.REACH + 1)):
                if i != j:
                    for a in own:
                        sums[a] += index[list(ws[j])].sum(0)
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    want = sums / (size + 10)
    want = np.where(size > 0, want - want.sum(0) / (size > 0).sum(), 0)
    vectors = qc.word_vectors(frame(spark, texts).repartition(3))
    assert np.allclose(vectors, want, atol=1e-5)
    rows = qc.pooled([t.encode() for t in texts], vectors, qc.known_entries())
    monkeypatch.setattr(qc, "LOT", 7)
    assert np.allclose(rows, qc.pooled([t.encode() for t in texts], vectors, qc.known_entries()), atol=0.2)  # lots only part neighbours
    for t, row in zip(texts, rows, strict=True):
        ws = [both(w) for w in t.split()]
        out = []
        for k in (0, 1):
            v = vectors[[w[k] for w in ws]].astype(float) if ws else np.zeros((0, qc.DIM))
            n = max(len(v), 1)
            mean, square = v.sum(0) / n, (v * v).sum(0) / n
            out += [mean, np.abs(np.diff(v, axis=0)).sum(0) / n if len(v) > 1 else np.zeros(qc.DIM), np.sqrt(np.maximum(square - mean**2, 0))]
        assert np.allclose(row, [*np.concatenate(out), np.log1p(len(ws))], atol=1e-4)


def test_temperature_is_fitted():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    net = quality_classifier.fit(x, y, epochs=60)
    p = net.scores(x)
    for low, high in ((0.1, 0.4), (0.4, 0.6), (0.6, 0.9)):
        some = (p >= low) & (p < high)
        assert abs(p[some].mean() - y[some].mean()) < 0.12


def test_ngrams_across_lots(monkeypatch):
    text = "".join(random.Random(1).choice("abc de") for _ in range(500))
    whole = toxicity.Features()(text)
    monkeypatch.setattr(toxicity, "LOT", 50)
    assert (toxicity.Features()(text) == whole).all()


# -- SimHash --------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, distance):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash(spark, texts, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.linked_by_distance(docs).collect()}
    fps = [plain_fingerprint(t, 3) for t in texts]
    comps = plain_components(list(range(len(texts))), fps, 2)
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, comps, strict=True))}


def test_simhash_links_by_planted_fingerprints(spark):
    rng = random.Random(4)
    fps = []
    for _ in range(60):
        fps.append(rng.getrandbits(64))
        for _ in range(rng.randint(0, 6)):
            one = rng.choice(fps)
            for _ in range(rng.randint(0, 3)):
                one ^= 1 << rng.randrange(64)
            fps.append(one)
    distinct = sorted(set(fps))
    items = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, f.to_bytes(8, "big")) for f in distinct], "id long, fp binary")
    edges = simhash.links(items, simhash.Covering(1, 1, 2), 2, len(distinct))
    roots = {r.u: r.v for r in common.components(edges).collect()}
    ids = [f - (1 << 64) if f >> 63 else f for f in distinct]
    assert [roots.get(i, i) for i in ids] == plain_components(ids, distinct, 2)


def test_anchors_cover():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 46, 300)
    row, key, home = simhash.anchors(x >> 23, x & (1 << 23) - 1, 2)
    assert home.sum() == 300
    mine = dict(zip(row[home], key[home], strict=True))
    for i in range(300):
        y = int(x[i]) ^ (1 << int(rng.integers(46))) ^ (1 << int(rng.integers(46)))
        _, near, _ = simhash.anchors(np.array([y >> 23]), np.array([y & (1 << 23) - 1]), 2)
        assert mine[i] in near


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(4000)]
    rows, copies = [], []
    for i in range(60):
        body = [rng.choice(words) for _ in range(200)]
        rows.append((i, " ".join(body)))
        if i < 30:  # a word in 100 changed: similarity of about 0.9
            for at in (50, 150):
                body[at] = rng.choice(words)
            copies.append((100 + i, " ".join(body)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (None, rows[1][1])]
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows + copies, "doc_id long, text string")).collect()}
    assert set(range(60)) <= got
    assert not {200, 201} & got
    assert len([c for c, _ in copies if c in got]) <= 1


def test_near_dedup_keeps_what_is_less_similar(spark):
    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(4000)]
    rows, pairs = [], []
    for i in range(60):
        body = [rng.choice(words) for _ in range(200)]
        rows.append((i, " ".join(body)))
        for at in range(8, 200, 38 if i < 30 else 100):  # similarity of about 0.77, and of about 0.9
            body[at] = rng.choice(words)
        rows.append((100 + i, " ".join(body)))
        one, other = ({tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows[-2:])
        pairs.append((i, len(one & other) / len(one | other)))
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(0.7 < s < 0.8 for _, s in pairs[:30])
    assert set(range(60)) | {100 + i for i, s in pairs if s < 0.8} <= got
    assert len([i for i, s in pairs if s >= 0.8 and 100 + i in got]) <= 1


def jaccard_of_shingles(texts, words):
    sets = [{tuple(t.split()[k : k + words]) for k in range(max(1, len(t.split()) - words + 1))} for t in texts]
    return lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])


def test_recall_and_precision_of_near_copies(spark):
    """Against all pairs compared exactly: most of what has the similarity, hardly above it too, is linked, nothing else."""
    rng = random.Random(26)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(4000)]
    texts = []
    for i in range(150):
        body = [rng.choice(words) for _ in range(rng.randint(60, 260))]
        texts.append(" ".join(body))
        for at in range(8, len(body), rng.choice([45, 50, 60, 90])):  # each word is in five shingles
            body[at] = rng.choice(words)
        texts.append(" ".join(body))
    similar = jaccard_of_shingles(texts, 5)
    due = {(i, i + 1) for i in range(0, 300, 2) if similar(i, i + 1) >= 0.8}
    barely = [p for p in due if similar(*p) < 0.85]
    assert len(due) > 80 and len(barely) > 20
    got = {r.doc_id: r.component_id for r in simhash.linked_by_similarity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    linked = {(c, d) for d, c in got.items() if c != d}
    assert linked <= due
    assert len(linked) >= 0.95 * len(due)
    assert len([p for p in barely if p in linked]) >= 0.9 * len(barely)


def test_a_group_of_texts_that_resemble_each_other(spark):
    """Over a hundred variants of a text: links are those of all pairs compared exactly, though each block sees a few."""
    rng = random.Random(27)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(4000)]
    body = [rng.choice(words) for _ in range(200)]
    texts = []
    for _ in range(130):
        own = list(body)
        for at in rng.sample(range(200), rng.choice([2, 4, 6, 8])):
            own[at] = rng.choice(words)
        texts.append(" ".join(own))
    similar = jaccard_of_shingles(texts, 5)
    root = list(range(130))
    for i in range(130):
        for j in range(i):
            if similar(i, j) >= 0.8 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = {r.doc_id: r.component_id for r in simhash.linked_by_similarity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), recall=0.9999).collect()}
    assert sum(got[i] != root[i] for i in range(130)) <= 6  # pairs farther apart by bits than the tables propose
    assert len(set(got.values())) > 1
    fp = [np.frombuffer(simhash._majority([simhash.shingle_set(t.encode(), 5)], 2), np.uint64) for t in texts]
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    pairs = simhash._verified(np.arange(130), np.arange(130) % 2, np.array(fp), sets, 128, 0.8)
    assert all(i % 2 != j % 2 and similar(i, j) >= 0.8 for i, j in pairs)


def test_crowded_anchors_are_split(spark, monkeypatch):
    """Anchors with more homes or rows than a task should hold: the same links, by parts that meet each other."""
    rng = random.Random(14)
    centre = rng.getrandbits(64)
    distinct = {centre}
    while len(distinct) < 500:
        one = rng.choice(sorted(distinct)) if rng.random() < 0.5 else centre
        for _ in range(rng.randint(1, 5)):
            one ^= 1 << rng.randrange(64)
        distinct.add(one)
    distinct = sorted(distinct)
    ids = [f - (1 << 64) if f >> 63 else f for f in distinct]
    items = spark.createDataFrame([(i, f.to_bytes(8, "big")) for i, f in zip(ids, distinct, strict=True)], "id long, fp binary")
    monkeypatch.setattr(simhash, "HOMES", 10)
    monkeypatch.setattr(simhash, "ROWS", 40)
    covering = simhash.Covering(1, 1, 2)
    parts = covering.split(items, len(distinct))
    assert max(parts.values()) > 4
    roots = {r.u: r.v for r in common.components(simhash.links(items, covering, 2, len(distinct))).collect()}
    assert [roots.get(i, i) for i in ids] == plain_components(ids, distinct, 2)


def test_only_tables_that_a_result_reads_stay(spark, docs):
    import os

    folder = common.shared_folder(spark).removeprefix("file://")

    def left(run):
        before = set(os.listdir(folder))
        out = run()
        if out is not None:
            out.collect()
        return sorted(n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before)

    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    assert left(lambda: simhash.keep_one(docs)) == ["gone"]
    assert left(lambda: simhash.linked_by_similarity(docs)) == ["linked"]
    assert left(lambda: simhash.linked_by_distance(docs)) == ["components", "fingerprints"]
    assert left(lambda: suffix_dedup.removed(docs)) == ["runs", "spans"]
    assert left(lambda: packing.pack_documents(docs, WORD_BPE)) == ["pieces"]
    assert left(lambda: quality_rules.judged(docs)) == left(lambda: quality_rules.keep_good(docs)) == []
    assert left(lambda: toxicity.toxicity(docs, labels)) == left(lambda: quality_classifier.quality(docs, labels)) == []
    assert left(lambda: token_counts.token_counts(docs, BYTES)) == ["histogram"]
    assert left(lambda: bpe.encoded(docs, MULTI)) == []
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.col("text").alias("html"))
    assert left(lambda: warc.archive(pages, common.new_path(spark, "warc")).rows()) == ["warc"]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    got = {r.u: r.v for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {v: v for e in edges for v in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {v: find(v) for v in root if find(v) != v}


# -- WARC -----------------------------------------------------------------------------------------------------------


def test_warc(spark, texts):
    pages = [(i, f"http://www.host{i % 3}.org/p/{i % 20}?q={i}" if i % 7 else None, t) for i, t in enumerate(texts)]
    pages += [(500, "http://A.org/x y", "z" * 70_000), (501, "http://a.org/\r\nevil: 1", "z" * 70_000), (None, "http://b.org", "alone"), (None, "http://b.org", "a")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.archive(df, common.new_path(spark, "warc"))
    owner = {}
    for i, _, t in pages:
        owner[t or ""] = max([x for x in (owner.get(t or ""), i) if x is not None], default=None)
    want = collections.Counter()
    for i, _, t in pages:
        digest = __import__("base64").b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
        o = owner[t or ""]
        want[i, len((t or "").encode()), digest, "response" if o == i or o is None else "revisit", None if o == i else o] += 1
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index.rows().collect())
    assert got == want
    for i, url, t in pages[20:26]:
        if url:
            found = [c for c in index.lookup(url) if c["page_id"] == i]
            assert len(found) == 1
            record = index.fetch(found[0])
            assert record["payload"] in (None, (t or "").encode())
    assert index.lookup("http://nowhere.org/") == []


def test_small_blocks_and_small_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(i, "http://a.org/same" if i % 2 else f"http://b.org/{i}", "x" * (i % 5)) for i in range(50)], "page_id long, url string, html string")
    index = warc.archive(pages, common.new_path(spark, "warc"), min_bytes=3)
    assert index.directory.count() >= 50 // 3
    assert [c["page_id"] for c in index.lookup("http://A.org/same")] == list(range(1, 50, 2))
    rows = index.rows().collect()
    assert all(r.record_type == "response" for r in rows if r.payload_bytes < 3)
    assert sum(r.record_type == "response" for r in rows if r.payload_bytes >= 3) == 2


def test_lookups_bisect_a_directory_of_many_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "PROBE", 150)
    monkeypatch.setattr(warc, "FILE_BYTES", 600)
    rng = random.Random(12)
    urls = [f"http://h{rng.randrange(40)}.org/{'x' * rng.randrange(60)}{rng.randrange(5)}" for _ in range(300)] + ["http://hot.org/"] * 40
    pages = spark.createDataFrame([(i, u, f"page {i % 50}", "extra") for i, u in enumerate(urls)], "page_id long, url string, html string, payload string").repartition(6)
    folder = common.new_path(spark, "warc")
    with spark_settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        index = warc.archive(pages, folder)
    assert index.directory.count() >= 340 // 2
    assert len(index._directory_files()) > 1
    sizes = [r.length for r in spark.read.format("binaryFile").load(f"{folder}/archives").select("length").collect()]
    assert len(sizes) > 6 and max(sizes) < 600 + 600
    want = collections.defaultdict(list)
    for i, u in enumerate(urls):
        want[u].append(i)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    for u in [*rng.sample(sorted(want), 25), "http://hot.org/", "http://a.org/", "http://zzz.org/", "http://h1.org/none"]:
        assert [c["page_id"] for c in index.lookup(u)] == want.get(u, [])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs  # no Spark job


def test_members_of_any_size_end_with_zero():
    big = b"x" * ((1 << 24) + 5)
    for data in (b"", b"a", big):
        row = warc._row([warc._member(data), warc._member(data)]) + b"\0"
        assert b"".join(d for _, _, d in warc.members(row)) == data * 2
    with pytest.raises(ValueError):
        list(warc.members(warc._member(b"abc" * 100)[:20]))
    record = warc.record(1, "http://a.org", b"payload", "A" * 32, None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse(record)


# -- token counts, byte pair encoding -------------------------------------------------------------------------------


def test_token_counts(spark, texts, docs):
    enc = tiktoken.Encoding("t", pat_str=tokens.pattern(), mergeable_ranks=tokens.read_ranks(BYTES), special_tokens={})
    lengths = [len(enc.encode_ordinary(t or "")) for t in texts]
    sums = token_counts.token_counts(docs, BYTES).cache()
    got = {r.n_tokens: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in got.items()} == collections.Counter(lengths)
    for limit, r in got.items():
        assert r.docs_ge == sum(n >= limit for n in lengths)
        assert r.tokens_ge == sum(n for n in lengths if n >= limit)
        assert r.truncated_tokens == sum(min(n, limit) for n in lengths)
        assert r.fraction_le == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))
    answers = token_counts.TokenCounts(sums)
    assert answers.total() == sum(lengths)
    for limit in (0, 3, 17, 100, 10**6):
        assert answers.truncated_total(limit) == sum(min(n, limit) for n in lengths)
    assert answers.quantile(0.5) == sorted(lengths)[-(-len(lengths) // 2) - 1]


@pytest.fixture(scope="module")
def ranks():
    return tokens.read_ranks(MULTI)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("t", pat_str=tokens.pattern(), mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs(spark, texts, docs, library):
    got = {r.doc_id: r for r in bpe.encoded(docs, MULTI, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert list(got[i].ids) == ids
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.data) for r in bpe.decoded(bpe.encoded(docs, MULTI, with_ids=True), MULTI).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abeinrst' \n\t\r!?12éß日\u00a0\x1c🙂")), max_size=60))
def test_encoding_is_the_library(library, ranks, text):
    e = bpe.encoder_of(MULTI)
    assert e.encode(text) == library.encode_ordinary(text)
    assert "".join(tokens.pieces(text)) == text


def test_joining_at_every_place(ranks, library):
    rng = random.Random(8)
    for leaf in (1, 2, 5, bpe.LEAF):
        e = bpe.Encoder(ranks, tokens.pattern(), leaf)
        for _ in range(300):
            data = "".join(rng.choice(["a", "th", "er", "in", "x", "é", "zz", "日本", "ий"]) for _ in range(rng.randint(1, 60))).encode()
            assert e.tree(data) == (whole := e.merged(data)) == tuple(library._core_bpe.encode_single_piece(data))
            cut = rng.randrange(len(data) + 1)
            assert e.join(e.merged(data[:cut]) if cut else (), e.merged(data[cut:]) if cut < len(data) else ()) == whole


def test_long_matches_go_through_the_tree(ranks, library):
    rng = random.Random(18)
    e = bpe.Encoder(ranks, tokens.pattern())
    for alphabet in ("ab", "etaoin", "日本語の", "a"):
        data = "".join(rng.choice(alphabet) for _ in range(20_000))
        assert e.encode(data) == library.encode_ordinary(data)
        assert e.decode(e.encode(data)) == data.encode()


def test_every_token_is_its_own_encoding(ranks):
    for token in random.Random(1).sample(list(ranks), 5000):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            assert best < 1 << 60
            parts[i : i + 2] = [parts[i] + parts[i + 1]]


# -- quality rules --------------------------------------------------------------------------------------------------


def test_quality_rules(spark, texts, docs):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        fives = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        count = collections.Counter(fives)
        again = len({p for k, f in enumerate(fives) if count[f] > 1 for p in range(k, k + 5)})
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), again)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(words) < 10 or 100 * again > 20 * len(words))
        assert not (r.base_failed and r.kept)


def test_order_of_rules_changes_nothing(docs):
    rows = quality_rules.measured(docs).cache()
    found = [*quality_rules.BASE, *quality_rules.rules(least_repeats=1)]
    stored = quality_rules.Stored(F.coalesce("text", F.lit("")))
    verdicts = []
    for order in (found, found[::-1], quality_rules.ordered(docs, found)):
        assert len(order) == len(found)
        verdicts.append([r.k for r in rows.select("doc_id", quality_rules.verdict(order, stored).alias("k")).orderBy("doc_id").collect()])
    assert verdicts[0] == verdicts[1] == verdicts[2]
    good = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert good == {r.doc_id for r in quality_rules.judged(docs).where("kept").collect()}


def test_order_follows_rejections_per_cost(spark):
    prose = " ".join(f"word{i} and some{i * 7} text" for i in range(100))
    docs = frame(spark, [prose.upper()] * 20 + [prose] * 60 + [f"{w} ### ### ###" for w in "abcdefghij" * 2]).repartition(2)
    found = [*quality_rules.BASE, *quality_rules.rules()]
    orders = [[r.name for r in quality_rules.ordered(docs, found, copies=40)] for _ in range(3)]
    # What rejects nothing comes last, as it was; the costly windows reject nothing here.
    assert all(o.index("repeated windows") > max(o.index("few words"), o.index("capitals")) for o in orders)
    assert all(o[-3:] == ["exclamations", "repeated lines", "word length"] or "word length" in o[:4] for o in orders)


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine", 5, "w", 9)], "doc_id long, text string, kept string, n_words int, _words string, __measures int")
    got = quality_rules.measured(docs).first().asDict()
    assert (got["n_words"], got["kept"], got["_words"], got["__measures"]) == (3, "mine", "w", 9)
    prose = " ".join(f"word{i} and some{i * 7} text" for i in range(40))
    kept = quality_rules.keep_good(docs.withColumn("text", F.lit(prose)))
    assert kept.columns == docs.columns
    assert kept.first().asDict() == docs.first().asDict() | {"text": prose}


def test_rules_reject_junk_and_keep_prose(spark):
    prose = " ".join(f"word{i} and some{i * 7} text" for i in range(40))
    junk = [" ".join(f"{w}###" for w in prose.split()), prose.upper(), "\n".join(["some line here that is long"] * 30), " ".join(w + "!" for w in prose.split())]
    kept = quality_rules.keep_good(frame(spark, [prose, *junk, None])).collect()
    assert [r.doc_id for r in kept] == [0]


# -- suffix dedup ---------------------------------------------------------------------------------------------------


def plain_removed(rows, length):
    seen = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            seen[k] = min(seen.get(k, (d, i)), (d, i))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] < (d, i):
                gone[i + 1 : i + 1 + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def as_counter(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shuffled", [False, True])
def test_suffix_dedup(spark, shuffled):
    texts = corpus(90, seed=3)
    ids = list(range(len(texts)))
    if shuffled:
        random.Random(4).shuffle(ids)
    assert as_counter(suffix_dedup.removed(frame(spark, texts, ids))) == plain_removed(list(zip(ids, texts, strict=True)), 100)


@pytest.mark.parametrize("segment", [1 << 18, 700, 130])
def test_every_window_lies_in_one_run(monkeypatch, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    suffix_dedup._constants.cache_clear()
    texts = [(t or "").encode() for t in corpus(40, seed=5)]
    seen = collections.Counter()
    anchors = {}
    for own, offsets, data, ends in suffix_dedup._segments(texts, 100):
        assert len(data) <= segment
        starts = np.concatenate([[0], ends[:-1]])
        for text, first, more, rel, anchor, _ in zip(*suffix_dedup.runs(data, ends), strict=True):
            lo = int(first - starts[text]) + offsets[text]
            for k in range(more + 1):
                seen[own[text], lo + k] += 1
                # Equal windows have equal anchors at equal places.
                found = anchors.setdefault(texts[own[text]][lo + k : lo + k + 100], (anchor, rel - k))
                assert found == (anchor, rel - k)
    assert seen == {(i, k): 1 for i, t in enumerate(texts) for k in range(len(t) - 99)}
    monkeypatch.undo()
    suffix_dedup._constants.cache_clear()


def test_rows_that_share_an_id_and_null_ids(spark):
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcd ") for _ in range(300)) for _ in range(2))
    rows = [(1, a), (1, a), (2, b), (2, b + a), (3, a[50:200])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_counter(suffix_dedup.removed(df)) == plain_removed(rows, 100)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.removed(spark.createDataFrame([(None, a), (9, a)], "doc_id long, text string")).collect()}
    assert got == {9: 0, None: 300}


def all_runs(texts, length=100):
    """Runs of texts as a task has them, and their bytes; a text's number is its doc."""
    found, parts = [], []
    for own, offsets, data, ends in suffix_dedup._segments(texts, length):
        text, first, more, rel, anchor, ctx = suffix_dedup.runs(data, ends, length)
        out = np.zeros(len(text), suffix_dedup.RUN)
        out["doc"], out["anchor"], out["ctx"], out["more"], out["rel"] = np.array(own)[text], anchor, ctx, more, rel
        out["lo"] = first - np.concatenate([[0], ends[:-1]])[text] + np.array(offsets)[text]
        out["part"], out["at"] = len(parts), first
        parts.append(data)
        found.append(out)
    return np.concatenate(found), parts


def plain_gone(texts, length=100):
    seen, gone = {}, [np.zeros(len(t) + 1, bool) for t in texts]
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            if seen.setdefault(t[i : i + length], (d, i)) != (d, i):
                gone[d][i : i + length] = True
    return gone


@pytest.mark.parametrize("collapse", [True, False])
def test_buckets_alone_decide_every_byte(monkeypatch, collapse):
    """No run is settled before; without collapse the sort decides about contexts that are equal as a whole too."""
    if not collapse:
        monkeypatch.setattr(suffix_dedup, "_whole", lambda rows: (rows, rows[:0]))
    texts = [(t or "").encode() for t in corpus(90, seed=3)]
    found, _ = all_runs(texts)
    rows = []
    for d, t in enumerate(texts):
        own = found[found["doc"] == d]
        rows.append(suffix_dedup.contexts(t, d, 0, own["lo"], own["lo"] + own["more"] + 100, own["anchor"].view(np.int64), own["rel"]))
    rows = np.concatenate(rows)
    got = [np.zeros(len(t) + 1, bool) for t in texts]
    for span in suffix_dedup.equal_windows(rows[np.argsort(rows["key"], kind="stable")]):
        got[span["doc"]][span["start"] : span["stop"]] = True
    assert all((a == b).all() for a, b in zip(got, plain_gone(texts), strict=True))


def test_hashes_alone_remove_nothing():
    """Where all contexts of an anchor have one hash, only those that hold the same bytes go."""
    texts = [(t or "").encode() for t in corpus(90, seed=3)]
    found, parts = all_runs(texts)
    found["ctx"] = 0
    stay, gone = suffix_dedup._split(found, parts, 100)
    assert len(stay) + len(gone) == len(found) and len(gone)
    want = plain_gone(texts)
    for run in gone:
        assert want[run["doc"]][run["lo"] : run["lo"] + run["more"] + 100].all()


def test_shortened_texts(spark):
    rng = random.Random(1)
    a = "é" + "".join(rng.choice("éßxyz") for _ in range(140)) + "é"
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.shortened(frame(spark, [a, "start " + a + " end", None])).collect()}
    assert got[0] == (a, len(a))
    assert got[1] == ("start  end", 10)
    assert got[2][0] is None


def test_difference_cover():
    for period in (8, 32, 50):
        found = suffix_dedup.cover(period)
        assert {(a - b) % period for a in found for b in found} == set(range(period))


def test_cover_ranks_sort_sample_suffixes():
    rng = np.random.default_rng(1)
    room = 160
    block = rng.integers(97, 99, 20 * room, np.uint8)
    block[room : 2 * room] = block[:room]
    rank = suffix_dedup.cover_ranks(block, room, 100)
    at = [i for i in range(len(block)) if i % room % 32 in suffix_dedup.cover(32)]
    text = lambda i: bytes(block[i : (i // room + 1) * room])[:128]
    by_rank = sorted(at, key=lambda i: rank[i])
    for i, j in zip(by_rank[:-1], by_rank[1:], strict=True):
        if len(text(i)) >= 100 <= len(text(j)):
            assert text(i)[:100] <= text(j)[:100]


# -- top-k ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e-3])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(400, 12)) * scale).astype(np.float32)
    x[100:160] = x[7]  # ties
    x[200] = 0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (950, [None] * 12), (951, [float("nan")] * 12), (952, [float("inf")] * 12), (None, rows[0][1]), (1000, [1.0, 2.0])]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>").repartition(5)
    vectors = topk.quantized(df)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()}
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    assert len(got) == 8 * 5
    for i in range(0, 400, 50):
        scores = q @ q[i]
        order = sorted((j for j in range(400) if j != i), key=lambda j: (-scores[j], j))[:5]
        assert [got[i, r + 1] for r in range(5)] == [(j, scores[j]) for j in order]


def test_columns_beside_the_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], 5, 6, 7.0) for i in range(60)], "vec_id long, embedding array<float>, score long, rank int, v double")
    vectors = topk.quantized(rows)
    assert topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).count() == 10


def test_fewer_vectors_than_k(spark):
    vectors = topk.quantized(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in topk.top_k(vectors, vectors.where("vec_id = 0")).collect())
    assert got == [(0, 1, 1), (0, 2, 1)]


def test_blocks_of_queries_and_shards_meet_without_copies(spark):
    """A block of queries once was copied to every group of shards, and shuffled."""
    vectors = topk.quantized(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "vec_id long, embedding array<float>"))
    plan = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" in plan


def test_the_kth_score_goes_on_from_shard_to_shard(monkeypatch):
    monkeypatch.setattr(topk, "STRIP", 8)
    rng = np.random.default_rng(5)
    for kind, scale in (("<i2", 40), ("<i4", 1 << 20), ("<i8", 1 << 27)):
        x, ids = (rng.normal(size=(900, 16)) * scale).astype(kind), rng.permutation(900)
        x[300:340] = x[5]
        asked = np.arange(0, 900, 30)
        best, got, rows = np.full((len(asked), 4), -np.inf), {}, []
        for at in range(0, 900, 100):
            found = [list(zip(*(c.tolist() for c in part), strict=True)) for part in topk.max_score(ids[asked], x[asked], ids[at : at + 100], x[at : at + 100], 4, best)]
            rows.append(sum(map(len, found)))
            for q, i, s in (r for part in found for r in part):
                got.setdefault(q, []).append((-s, i))
        if kind != "<i8":
            assert rows[-1] < rows[0] / 2
        for n in asked:
            scores = x.astype(np.int64) @ x[n].astype(np.int64)
            assert sorted(got[ids[n]])[:4] == sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != ids[n])[:4]


# -- the queries and the pipeline -----------------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    import glob
    import os

    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("the tables aren't here")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    plain = lambda d: d[columns].astype(object).where(d[columns].notna(), None).map(lambda v: int(v) if isinstance(v, float) else v).astype(str).sort_values(columns).values.tolist()
    assert plain(ours) == plain(theirs)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    rows, labels, junk = [], [], set()
    for i in range(400):
        body = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        if i % 4 == 0:
            body = [w.upper() + "!!" for w in body]
            junk.add(i)
        rows.append((i, " ".join(body), "en", "s", 0))
        labels.append((i, int(i not in junk), 0))
    rows += [(1000, rows[1][1], "en", "s", 0), (1001, rows[2][1] + " zz", "en", "s", 0)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows += [(2000 + k, " ".join(rng.choice(words) for _ in range(60)) + " " + passage, "en", "s", 0) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.keep(stage(spark, docs, f"file://{tmp_path}"), "stage")
        assert docs.columns == df.columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = set(range(400)) - junk
    assert len(clean & set(seen["quality rules"])) >= 0.98 * len(clean)
    assert not junk & set(seen["quality rules"])
    assert not {1000, 1001} & set(seen["simhash near-dedup"])
    assert sum(passage in t for t in seen["suffix-array dedup"].values()) == 1
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in got} == set(seen["suffix-array dedup"])
    fill = collections.Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


@pytest.mark.parametrize(("before", "after"), [("64m", str(4 << 20)), ("67108864b", str(4 << 20)), ("1k", "1k"), ("5000", "5000"), ("4mb", "4mb")])
def test_batches_are_bounded(spark, before, after):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    with spark_settings(spark, {name: before}):
        common.bounded(spark.range(1))
        assert spark.conf.get(name) == after


def test_frames_of_pandas(spark):
    """Texts that pandas made have no other results."""
    df = spark.createDataFrame(pd.DataFrame({"doc_id": [1, 2], "text": ["a b c d", "a b c d"]}))
    assert {r.component_id for r in simhash.linked_by_distance(df).collect()} == {1}
