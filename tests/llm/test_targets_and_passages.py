"""Quality by passages, clustering with heaps of bounds, and resampling towards a target."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fileledger.llm import heap_clustering, labelled, passage_quality, target_resampling
from fileledger.llm.entries import QUERIES
from fileledger.llm.kernel import slices

from .conftest import SF, frame, words

# ---- resampling


def target_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_resampling(docs, target, cfg):
    def runs(text):
        w = target_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % cfg.buckets for n in range(1, cfg.longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in runs(x)), Counter(b for x in target for b in runs(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + cfg.buckets) / ((s[b] + 1) * (all_t + cfg.buckets)))) for b in range(cfg.buckets)}
    out = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{cfg.seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in runs(x))
        out.append([i, len(target_words(x)), len(runs(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= cfg.least_words), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(able[: cfg.percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out))


def test_crc_columns():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(rng.choice((1, 2, 7, 8, 9, 16, 17, 300)))) for _ in range(400)] * 2
    data = np.frombuffer(b"".join(texts), np.uint8)
    length = np.array([len(t) for t in texts])
    start = np.cumsum(length) - length
    assert target_resampling.crc_of_spans(data, start, length).tolist() == [zlib.crc32(t) for t in texts]


def test_crc_in_parts(monkeypatch):
    monkeypatch.setattr(target_resampling, "MATRIX_BYTES", 64)
    data = np.frombuffer(b"abcdefgh" * 40, np.uint8)
    start, length = np.arange(300), np.tile([3, 5, 3, 11], 75)
    assert target_resampling.crc_of_spans(data, start, length).tolist() == [zlib.crc32(bytes(data[s : s + n])) for s, n in zip(start, length)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_of_odd_texts(spark, odd_texts, longest):
    rng = random.Random(2)
    cfg = target_resampling.Resampling(longest=longest, buckets=97, percent=40)
    texts = [*odd_texts, "A b É ÉE x1_y-z", *(words(rng, rng.randrange(5, 60), 50) for _ in range(60))]
    docs = frame(spark, texts)
    target = spark.createDataFrame([("w1 w2 w3 w4",), (None,), ("",), ("w1 W1 b é",)], "text string")
    got = sorted(tuple(r) for r in target_resampling.resample(docs, target, cfg).collect())
    assert got == brute_resampling(list(enumerate(texts)), [r.text for r in target.collect()], cfg)


def test_resampling_of_repeats_nulls_and_nothing(spark):
    cfg = target_resampling.Resampling(least_words=1, percent=100, buckets=16)
    schema = "doc_id bigint, text string, score string, rank string, bucket string, _place string"
    docs = spark.createDataFrame([(i, "a b c", "s", "r", "b", "p") for i in (5, 5, 3, None, None)] + [(7, None, "s", "r", "b", "p")], schema)
    target = spark.createDataFrame([("a",)], "text string")
    rows = target_resampling.resample(docs, target, cfg).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4, 5]
    assert [r["rank"] for r in rows if r.doc_id == 7] == [None] and len({r.score for r in rows if r.doc_id == 5}) == 1
    assert target_resampling.resample(docs.limit(0), target, cfg).count() == 0
    assert target_resampling.resample(docs, target.limit(0), cfg).count() == 6


def test_resampling_query(spark, documents):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_resampling([(r.doc_id, r.text) for r in documents.collect()], target, target_resampling.Resampling())
    got = sorted(tuple(r) for r in QUERIES["op13_target_resampling"](spark, SF).collect())
    assert got == [(i, *rest) for i, _, *rest in want]


# ---- clustering


def brute_clusters(rows, cfg):
    """rows: (id, components).  Plain rounds of exact whole numbers."""
    kept = [(i, [math.floor(cfg.scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == cfg.dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{cfg.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[: cfg.clusters]
    centroids = [v for _, v in first]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(centroids)), key=lambda j: (away(v, centroids[j]), j)) for _, v in kept]
    for _ in range(cfg.rounds):
        at = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign()
    distance = [away(v, centroids[a]) for (_, v), a in zip(kept, at)]
    of = Counter()
    for a, d in zip(at, distance):
        of[a] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, a, d, of[a], sum(distance), sha[a]) for (i, _), a, d in zip(kept, at, distance)]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("seed, dims, clusters, spread", [(0, 4, 5, 0.3), (1, 2, 8, 3.0), (2, 3, 1, 1.0), (3, 1, 4, 0.0)])
def test_clusters_as_plain_rounds(spark, monkeypatch, seed, dims, clusters, spread):
    monkeypatch.setattr(heap_clustering, "BLOCK_BYTES", 4 * dims * 16)
    rng = random.Random(seed)
    cfg = heap_clustering.Clustering(dimensions=dims, clusters=clusters, rounds=10, scale=16)
    centres = [[rng.uniform(-2, 2) for _ in range(dims)] for _ in range(6)]
    rows = [(rng.randrange(300), [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for _ in range(400)] + [(None, [0.5] * dims)] * 2
    odd = [(900, None), (901, []), (902, [1.0] * (dims + 1)), (903, [None] * dims), (904, [float("nan")] * dims), (905, [float("-inf")] * dims)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows + odd], "vec_id bigint, embedding array<double>, block string, cluster int, id int")
    found = heap_clustering.cluster_vectors(df, cfg)
    assert in_order(found.rows.collect()) == in_order(brute_clusters(rows, cfg))
    assert found.compared[0] == len(rows)
    if spread == 0.3:
        assert sum(found.compared[1:]) < 0.8 * len(rows) * (len(found.compared) - 1)  # bounds save comparisons


def test_few_or_no_vectors(spark):
    cfg = heap_clustering.Clustering(dimensions=2, clusters=8)
    df = spark.createDataFrame([(1, [0.0, 1e30]), (2, [-1e30, 0.0]), (2, [-1e30, 0.0])], "vec_id bigint, embedding array<double>")
    rows = heap_clustering.cluster_vectors(df, cfg).rows.collect()
    assert [r.distance for r in rows] == [0, 0, 0] and len({r.cluster for r in rows}) == 2
    none = heap_clustering.cluster_vectors(df.limit(0), cfg).rows
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_rounds_join_without_an_exchange(spark):
    df = spark.range(500).selectExpr("id as block", "cast(array(id % 7, id % 11) as array<double>) as v")
    with heap_clustering.BucketedTables(spark, 4) as tables:
        blocks = tables.written(df, "test_blocks")
        state = tables.written(df.selectExpr("block", "cast('x' as binary) as heaps"), "test_heaps")
        joined = heap_clustering._with_heaps(blocks, state)
        assert joined.count() == 500 and "Exchange hash" not in joined._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name in tables.names]


def test_clustering_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op12_heap_clustering"](spark, SF)
    assert in_order(got.collect()) == in_order(brute_clusters(rows, heap_clustering.Clustering()))


# ---- quality by passages


def test_passages_cover_texts():
    texts = ["", " \n", "one", " ".join(f"w{i}" for i in range(100)) + "\n", "a a a b", "$$$ ### " * 200]
    s = passage_quality.passages_of_all(texts)
    assert np.diff(s.by_doc).tolist() == [0, 0, 1, 3, 1, 13]
    assert np.diff(s.first_word).sum() == 1 + 100 + 4 + 400
    pairs = (s.fixed[:, : -passage_quality.STATISTICS] ** 2).sum(axis=1)
    assert np.allclose(pairs, 1)
    different, again = s.fixed[4, -passage_quality.STATISTICS], s.fixed[4, 1 - passage_quality.STATISTICS]
    assert (different, again) == (0.5, 0.5)


def test_class_pairs_of_one_long_passage(monkeypatch):
    data = np.frombuffer(b"aA1 $a" * 50, np.uint8)
    want = passage_quality._class_pairs(data, np.array([0, 100]), np.array([90, 299]))
    monkeypatch.setattr(passage_quality, "_SMALL", 17)
    assert np.allclose(passage_quality._class_pairs(data, np.array([0, 100]), np.array([90, 299])), want)


def test_gradients_of_attention():
    rng = random.Random(4)
    s = passage_quality.passages_of_all([words(rng, n) for n in (3, 90, 200, 40)])
    known = np.ones(passage_quality.WORDS, bool)
    net = passage_quality.Network(s.fixed.mean(axis=0), s.fixed.std(axis=0) + 0.5, known)
    net.p = {k: (v + np.random.default_rng(1).normal(size=v.shape) * 0.1).astype(np.float64) for k, v in net.p.items()}
    y, w = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])

    def loss():
        z = net.forward(s)[0]
        return (w * (np.logaddexp(0, z) - y * z)).mean()

    got = net.gradients(s, y, w)
    for name, v in net.p.items():
        for at in [np.unravel_index(k, v.shape) for k in (np.flatnonzero(got[name])[[0, -1]])]:
            kept = v[at]
            v[at] = kept + 1e-5
            up = loss()
            v[at] = kept - 1e-5
            down = loss()
            v[at] = kept
            assert got[name][at] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=1e-6), name


def test_attention_weighs_the_passage_that_decides():
    rng = random.Random(5)
    good = [words(rng, 200, 500) for _ in range(150)]
    bad = [words(rng, 90, 500) + " $$## %%&& ||<>" * 12 + " " + words(rng, 90, 500) for _ in range(150)]
    model = passage_quality.train(good + bad, np.arange(300) < 150)
    s = passage_quality.passages_of_all([words(rng, 90, 500) + " $$## %%&& ||<>" * 12 + " " + words(rng, 90, 500), words(rng, 300, 500)])
    _, weight = model.network.forward(s)
    scores = model.scores(s)
    assert scores[0] < 0.3 and scores[1] > 0.7
    n = int(s.by_doc[1])
    assert np.allclose([weight[:n].sum(), weight[n:].sum()], 1, atol=1e-5)


def test_quality_of_odd_rows(spark, odd_texts, labels):
    rng = random.Random(6)
    docs = frame(spark, odd_texts + [words(rng, 100) for _ in range(20)] + ["$$$ ### !!! " * 30] * 20)
    known = spark.createDataFrame([(i, int(i < 31), "x") for i in range(11, 51)] + [(12, 0, "x"), (13, None, "y"), (None, 1, "z")], "doc_id bigint, quality int, text string")
    rows = {r.doc_id: r for r in passage_quality.score_quality(docs, known).collect()}
    assert len(rows) == 51 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    assert rows[0].score == rows[1].score == rows[2].score < 0.7
    assert len({rows[i].score for i in range(31, 51)}) == 1
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert {r.score for r in passage_quality.score_quality(docs, known.limit(0)).collect()} == {0.0}
    assert passage_quality.score_quality(docs.limit(0), known).count() == 0


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (10 + i % 3)) for i in range(400)] + [(1, "other"), (2, None)], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, 0)], "doc_id bigint, quality int")
    bounds = labelled.SampleBounds(positive=50, negative=30, text_bytes=11, total_bytes=300)
    texts, good = labelled.labelled_sample(docs, known, "quality", bounds)
    assert sum(map(len, texts)) <= 300 and 0 < good.sum() < len(good) <= 30 and max(map(len, texts)) <= 11
    fit = {r.doc_id for r in known.where(~labelled.held_out(known.doc_id)).collect()}
    everything = labelled.SampleBounds(10**6, 10**6, 10**6, 10**9)
    low, high = (labelled.labelled_sample(docs, known, "quality", everything, highest=h)[1].sum() for h in (False, True))
    assert high - low == (3 in fit) and len(labelled.labelled_sample(docs, known, "quality", everything)[0]) == len(fit)


def test_quality_held_out(spark):
    folder = SF.replace("0.001", "0.01")
    rows = QUERIES["op11_passage_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert sum(r.predicted for r in rows if r.quality) >= 0.98 * sum(r.quality for r in rows)


def test_scores_do_not_depend_on_the_slice():
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(1, 400), 300) for _ in range(40)]
    model = passage_quality.train(texts[:20] + ["!! ## " * 40] * 20, np.arange(40) < 20)
    whole = model.scores(passage_quality.passages_of_all(texts))
    parts = np.concatenate([model.scores(passage_quality.passages_of(p)) for p in slices(pa.array(texts), 3000)])
    assert np.abs(whole - parts).max() <= 2e-6
