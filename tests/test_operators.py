"""Vector operators against numpy on clouds of points."""

import math
import os
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratavec.functions import hashing, vectors
from stratavec.functions.hashing import HashFamily
from stratavec.operators import ann, blocks, components, dbscan, estimators, gradient, kmeans, metrics, nearest, pq, projection, sampling, tuning
from stratavec.sources import vectors as sources
from stratavec.sources.catalog import Engine
from stratavec.sources.reports import Report
from stratavec.streaming import ingest


@pytest.fixture(scope="module")
def cloud(spark):
    return sources.blobs(spark, 300, dim=8, centres=3, spread=0.5).cache()


@pytest.fixture(scope="module")
def local(cloud):
    rows = cloud.orderBy("id").collect()
    return np.array([r.v for r in rows]), np.array([r.label for r in rows])


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_exact_neighbours(cloud, local, metric):
    x, _ = local
    q = cloud.where("id < 10").select(F.col("id").alias("q_id"), "v")
    got = {(r.q_id, r.rn): (r.id, r.dist) for r in ann.exact_knn(cloud, q, 3, metric).collect()}
    for i in range(10):
        d = {"euclidean": np.linalg.norm(x - x[i], axis=1), "manhattan": np.abs(x - x[i]).sum(1), "cosine": 1 - x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])}[metric]
        d[i] = np.inf
        for rank, j in enumerate(np.argsort(d, kind="stable")[:3], 1):
            assert got[i, rank][0] == j
            assert got[i, rank][1] == pytest.approx(d[j])


def test_blocks_agree_with_pairs(cloud, local):
    x, _ = local
    q = cloud.where("id < 5").select(F.col("id").alias("q_id"), "v")
    plain = sorted((r.q_id, r.rn, r.id) for r in ann.exact_knn(cloud, q, 4).collect())
    assert plain == sorted((r.q_id, r.rn, r.id) for r in ann.exact_knn_blocks(cloud, x[:5], np.arange(5), 4).collect())


def test_index_arrow_agrees_with_columns(cloud):
    f = HashFamily.draw(8, 3, 2, 2.0)
    a, b = ann.build_index(cloud, f), ann.build_index(cloud, f, arrow=True)
    assert a.exceptAll(b).isEmpty()
    assert a.count() == 900
    assert ann.bucket_sizes(a).agg(F.sum("bucket_size")).first()[0] == 900


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_more_probes_find_more(cloud, metric):
    f = HashFamily.draw(8, 2, 3, 1.0, metric)
    index = ann.build_index(cloud, f)
    q = cloud.where("id % 20 = 0").select(F.col("id").alias("q_id"), "v")
    few, many = ann.candidates(q, index, f, 1), ann.candidates(q, index, f, 7)
    assert few.exceptAll(many).isEmpty()
    assert few.where("q_id = id").count() == q.count()


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_radius_neighbours_in_blocks(spark, cloud, local, metric, monkeypatch):
    x, _ = local
    x = np.concatenate([x, x[:3], np.zeros((2, 8))])  # copies and vectors without a direction
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    d = blocks.matrix(x, x, metric)
    eps = {"euclidean": 1.5, "manhattan": 3.0, "cosine": 0.01}[metric]
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= eps}
    monkeypatch.setattr(blocks, "ROWS", 16)
    for cells in (None, 7):
        got = ann.radius_neighbours(points, eps, metric, cells).collect()
        assert {(r.a, r.b) for r in got} == want
        assert len(got) == len(want)
        assert np.allclose([r.dist for r in got], [d[r.a, r.b] for r in got])
    assert ann.radius_neighbours(points.limit(0), 1.0).isEmpty()


def test_far_blocks_never_meet(spark, monkeypatch):
    """Clouds far apart: few of all pairs of blocks are measured."""
    monkeypatch.setattr(blocks, "ROWS", 20)
    points = sources.blobs(spark, 1000, dim=2, centres=10, spread=0.01).select("id", "v")
    looked = spark.sparkContext.accumulator(0)
    measure = blocks._upper

    def counted(*args):
        looked.add(1)
        return measure(*args)

    monkeypatch.setattr(blocks, "_upper", counted)
    assert blocks.near_pairs(points, 0.05, cells=30).count() > 0
    assert looked.value < 0.25 * 120 * 121 / 2  # about 120 blocks, 30 cells in each of 4 tasks


def test_quantiles_of_all_pairs(cloud, local):
    x, _ = local
    for metric in ("euclidean", "manhattan", "cosine"):
        d = blocks.matrix(x, x, metric)[np.triu_indices(len(x), 1)]
        found, mean = blocks.quantiles(cloud, [0.0, 0.1, 0.25, 0.5, 1.0], metric, bins=16, few=50)
        assert np.allclose(found, np.percentile(d, [0, 10, 25, 50, 100]), atol=1e-9)
        assert mean == pytest.approx(d.mean())
    assert blocks.quantiles(cloud.limit(1), [0.5]) == ([None], None)
    same = cloud.select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert blocks.quantiles(same, [0.1, 0.9], few=5) == ([0.0, 0.0], 0.0)


def test_covariance_is_numpys(cloud, local):
    x, _ = local
    got = np.zeros((8, 8))
    for r in estimators.covariance(cloud.withColumn("v", F.transform("v", lambda a: a + 1e6))).collect():
        got[r.i, r.j] = got[r.j, r.i] = r["cov"]
    assert np.allclose(got, np.cov(x.T), atol=1e-6)


@pytest.mark.parametrize("lot", [1_000_000, 7])
def test_components(spark, monkeypatch, lot):
    monkeypatch.setattr(components, "LOT", lot)
    rng = np.random.default_rng(3)
    edges = [*map(tuple, rng.integers(0, 500, (400, 2)).tolist()), *((i, i + 1) for i in range(1000, 1200)), (5, 5)]
    root = {v: v for e in edges for v in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = components.components(spark.createDataFrame(edges, "u long, v long").repartition(6))
    assert {r.u: r.v for r in found.collect()} == {v: find(v) for v in root if find(v) != v}
    assert components.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_numbers_follow_the_order(spark):
    values = spark.range(0, 5000, 7).repartition(5)
    assert sorted((r.n, r.id) for r in dbscan.numbered(values, "id", "n").collect()) == [(k + 1, 7 * k) for k in range(715)]


def test_dbscan_finds_the_clouds(spark):
    points = sources.blobs(spark, 150, dim=2, centres=3, spread=0.2)
    labels = dbscan.DBSCAN(1.0, 4)
    found = labels.fit(points).join(points, "id")
    assert metrics.adjusted_rand(found, "label", "cluster").first()[0] > 0.95
    far = spark.createDataFrame([(999, [1e6, 1e6])], "id long, v array<double>")
    assert labels.predict(far).first().cluster == 0


def test_kmeans_and_gradient(cloud):
    model = kmeans.KMeans(3, init="k-means++", standardize=True).fit(cloud)
    assert metrics.adjusted_rand(model.transform(cloud.withColumnRenamed("label", "truth")), "truth", "label").first()[0] > 0.95
    before = gradient.GradientKMeans(3, steps=1, seed=1).fit(cloud)
    after = gradient.GradientKMeans(3, steps=8, rate=0.3, seed=1).fit(cloud)
    assert after.score(cloud) <= before.score(cloud)
    part = kmeans.KMeans(3)
    for k in range(3):
        part.partial_fit(cloud.where(F.col("id") % 3 == k))
    assert part.counts.sum() == 300


def test_standardized_centres_return_to_their_space(cloud, local):
    scale = kmeans.Scale.fit(cloud)
    assert np.allclose(scale.mean, local[0].mean(0))
    assert np.allclose(scale.undo(np.zeros((1, 8)))[0], scale.mean)


def test_kmodes(spark):
    rows = [(i, ["a", "b", "c"] if i % 2 else ["x", "y", "z"]) for i in range(20)] + [(20, ["a", "b", "z"])]
    df = spark.createDataFrame(rows, "id long, v array<string>")
    model = kmeans.KModes(2).fit(df)
    assert len(model.modes) == 2
    assert model.score(df) < 0.5


def test_silhouette_and_sizes(cloud, local):
    x, y = local
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = []
    for i in range(300):
        own = d[i][(y == y[i]) & (np.arange(300) != i)].mean()
        other = min(d[i][y == k].mean() for k in set(y) - {y[i]})
        want.append((other - own) / max(own, other))
    assert metrics.silhouette(cloud).first()[0] == pytest.approx(np.mean(want))
    assert metrics.silhouette(cloud.withColumn("label", F.lit(0))).first()[0] == -1.0
    assert metrics.cluster_sizes(cloud, 5).agg(F.sum("size")).first()[0] == 300


def test_quantizer(cloud, local):
    x, _ = local
    book = pq.train(cloud, 8, 4, 16, 3)
    codes = cloud.select("id", "v", book.encode(F.col("v")).alias("c"), book.encode_arrow()("v").alias("a"))
    assert codes.where("c <> a").isEmpty()
    error = pq.reconstruction_error(cloud, book).first()
    assert error.mse_row < x.var(0).sum()
    assert pq.Codebook.from_json(book.to_json()) == book
    beyond = codes.limit(1).select(book.decode(F.array(*[F.lit(99)] * 4)).alias("v")).first().v
    assert beyond == [0.0] * 8
    turn = pq.rotation(cloud, 8)
    assert np.allclose(turn @ turn.T, np.eye(8))
    turned = pq.train(cloud, 8, 4, 16, 2, rotation=turn)
    assert pq.reconstruction_error(cloud, turned).first().mse_row < x.var(0).sum()
    small, goes = pq.compressed(book, {}, threshold=1e9, least=3)
    assert [len(c) for c in small.centroids] == [3] * 4
    assert all(0 <= g < 3 for m in goes for g in m)


def test_models_are_stored_and_copied(spark, tmp_path, cloud):
    rows = spark.createDataFrame([(i, [str(i % 3), str(i % 2), "x"]) for i in range(60)], "id long, v array<string>")
    for k, (model, data) in enumerate(((kmeans.KMeans(3, standardize=True), cloud), (gradient.GradientKMeans(3, steps=3), cloud), (kmeans.KModes(4), rows))):
        model.fit(data)
        path = f"file://{tmp_path}/{k}"
        model.save(spark, path)
        again = type(model).load(spark, path)
        assert sorted(map(tuple, again.predict(data).select("id", "label").collect() if k else again.transform(data).select("id", "label").collect())) == sorted(map(tuple, model.predict(data).select("id", "label").collect() if k else model.transform(data).select("id", "label").collect()))
        twin = model.copy()
        assert model.history_frame(spark).count() == twin.history_frame(spark).count() > 0
        with pytest.raises(ValueError, match="holds a"):
            (kmeans.KModes if k < 2 else kmeans.KMeans).load(spark, path)
    part = kmeans.KMeans.load(spark, f"file://{tmp_path}/0")
    before = part.counts.sum()
    assert part.partial_fit(cloud).counts.sum() == 2 * before  # goes on where it was


def test_kmodes_starts_and_refills(spark):
    rows = [(i, [f"a{i // 10}", f"b{i // 10}", "c"]) for i in range(40)]
    points = spark.createDataFrame(rows, "id long, v array<string>")
    model = kmeans.KModes(4, init="++").fit(points)
    assert model.score(points) == 0.0
    assert sorted(model.sizes[-1]) == [10, 10, 10, 10]
    stuck = kmeans.KModes(3, steps=1)
    stuck._start = lambda p: [rows[0][1], rows[0][1], rows[10][1]]
    stuck.fit(points)
    assert stuck.sizes[0][1] == 0 and stuck.modes[1] in [r for _, r in rows[20:]]
    assert model.fit_incremental(points.where("id < 20"), points.where("id >= 20")).score(points) == 0.0


def test_invalid_vectors_and_centres(spark, cloud):
    bad = spark.createDataFrame([(1000, [float("nan")] * 8), (1001, None), (1002, [1.0, None] + [0.0] * 6), (1003, [float("inf")] * 8), (1004, [1.0])], "id long, v array<double>")
    rows = cloud.select("id", "v").unionByName(bad)
    assert kmeans.valid(rows, 8).count() == 300
    assert np.isfinite(kmeans.KMeans(3).fit(rows.where("id <> 1004")).centres).all()
    old = np.zeros((1, 2))
    assert kmeans.valid_centres([[1, 2], [np.nan, 1], [1, 2, 3], [np.inf, 0]], 2, old).tolist() == [[1.0, 2.0]]
    assert kmeans.valid_centres([[np.nan, 1]], 2, old) is old
    line = np.array([[0.0], [0.1], [5.0], [10.0], [9.9]])
    assert len(kmeans.diverse(line, 9)) == 5
    assert {round(x) for x in kmeans.diverse(line, 3).ravel()} == {0, 5, 10}


def test_chunks_and_partitions(spark, cloud):
    parts = kmeans.chunks(cloud, 100)
    assert parts.select("chunk").distinct().count() == 3
    assert parts.count() == 300
    assert kmeans.sized(cloud.repartition(40), 8).rdd.getNumPartitions() == 1
    assert kmeans.sized(cloud.repartition(1), 8).rdd.getNumPartitions() == 1


def test_ward_finds_the_clouds(spark):
    points = sources.blobs(spark, 120, dim=3, centres=4, spread=0.2)
    found = metrics.ward(points, 4).join(points.withColumnRenamed("label", "truth"), "id")
    assert metrics.adjusted_rand(found, "truth", "label").first()[0] == 1.0
    assert metrics.ward(points, 4, sample=40).select("label").distinct().count() == 4


def test_losses_with_and_without_gradients(cloud):
    for loss in ("cluster_variance", "entropy", "repulsion"):
        model = gradient.GradientKMeans(3, steps=6, rate=0.3, loss=loss).fit(cloud)
        assert model.history[-1][1] < model.history[0][1]
    a, b = (gradient.GradientKMeans(3, steps=3, loss=loss).fit(cloud) for loss in ("standard", "entropy"))
    assert np.allclose(a.centres, b.centres)
    assert [h[1] for h in a.history] != [h[1] for h in b.history]
    with pytest.raises(ValueError):
        gradient.GradientKMeans(3, loss="other")


def test_quantizer_evaluation(spark, cloud):
    book = pq.train(cloud, 8, 4, 16, 3)
    q = cloud.where("id < 20").select(F.col("id").alias("q_id"), "v")
    r = tuning.evaluate_clusters(cloud, q, book, 3).first()
    assert r.ari_before > 0.9 and r.ari_after > 0.9
    assert 0.5 < r.silhouette_before <= 1 and 0.5 < r.silhouette_after <= 1
    assert r.compression_ratio == pytest.approx(book.ratio(300))
    assert book.ratio(300, maps=[[0] * 16] * 4) < book.ratio(300)
    assert pq.hash_ratio(320, 10, 16) == 64


def test_sampler_follows_the_weights(spark):
    rows = spark.createDataFrame([(i, float(1 + i % 3)) for i in range(30)], "id long, weight double")
    drawn = sampling.create_sampler(rows, 6000)
    assert drawn.count() == 6000
    got = {r.w: r.n for r in drawn.join(rows, "id").groupBy(F.col("weight").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert all(abs(got[w] - 1000 * w) < 200 for w in (1.0, 2.0, 3.0))


def test_splits():
    assert pq.nearest_divisor(12, 5) == 4
    assert pq.splits(10, 3) == [(0, 4), (4, 3), (7, 3)]
    assert pq.splits(10, 3, exact=True) == [(0, 5), (5, 5)]


def test_sample_quotas_and_weights(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").when(F.col("id") < 990, "b").otherwise("c").alias("k"))
    got = sampling.stratified(rows, "k", 100)
    assert got.count() == 100
    assert got.agg(F.sum("weight_ht")).first()[0] == pytest.approx(1000)
    even = sampling.stratified(rows, "k", 100, "balanced").join(rows, "id").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in even} == {"a": 34, "b": 34, "c": 10}
    assert sampling.reservoir(rows, 10).count() == 10


def test_importance_estimate_is_near(spark):
    rows = spark.range(5000).select("id", F.pmod("id", F.lit(10)).alias("k"), (F.pmod("id", F.lit(10)) * 1.0 + hashing.uniform(1, F.col("id"))).alias("f"))
    got = sampling.importance_sample(rows, "k", F.col("f"), 1000, "proportional", temperature=1e3, cap=200, linear=True).join(rows, "id")
    assert estimators.expectation(got, F.col("f")).first()[0] == pytest.approx(5.0, abs=0.2)
    assert 0 < estimators.effective_size(got).first()[0] <= 1000.0001


def test_draws_with_replacement_follow_the_odds(spark):
    odds = spark.createDataFrame([(i, 0.5 if i == 0 else 0.5 / 99) for i in range(100)], "id long, q double")
    got = sampling.with_replacement(odds, 90)
    assert got.count() == 90
    assert 25 <= got.where("id = 0").count() <= 65
    assert sampling.with_replacement(odds, 100).count() == 100


@given(st.floats(0.1, 5), st.floats(0.1, 5))
def test_collision_odds(distance, width):
    t = np.linspace(0, width, 4001)
    y = np.exp(-((t / distance) ** 2) / 2) / (distance * math.sqrt(2 * math.pi)) * (1 - t / width)
    assert hashing.collision_probability(distance, width) == pytest.approx(np.trapezoid(y, t), abs=1e-5)


def test_tuning(cloud):
    found = tuning.optimize(cloud, 8, sample=100)
    assert 0 < found.rho < 1
    assert found.cR == 2 * found.R
    values = tuning.starting_values(cloud)
    assert values["w"] >= 0.1
    running = tuning.RunningRadius()
    for _ in range(5):
        running.update(cloud)
    assert running.radius == pytest.approx(running.mean / 2)


def test_engine(spark, tmp_path, cloud):
    engine = Engine(spark, f"file://{tmp_path}/engine")
    assert engine.health() == {"status": "ok"}
    engine.create_dataset("a", 8, w=2.0, k=2, pq_num_subspaces=4, pq_num_clusters=8, sampling_ratio=1.0)
    with pytest.raises(ValueError):
        engine.create_dataset("a", 8)
    with pytest.raises(ValueError):
        engine.create_dataset("b", 8, distance_metric="none")
    with pytest.raises(KeyError):
        engine.dataset("missing")
    first = engine.ingest("a", cloud.where("id < 200"), "one")
    engine.ingest("a", cloud.where("id < 200"), "one")  # repeated
    engine.ingest("a", cloud.where("id >= 200"))
    assert first == "one"
    assert engine.points("a").count() == 300
    assert engine.batch_info("a", "one")["size"] == 200
    q = cloud.where("id < 3").select(F.col("id").alias("q_id"), "v")
    assert {r.id for r in engine.query("a", q, 1).collect()} == {0, 1, 2}
    assert engine.sample("a", size=50).count() == 50
    engine.train_pq("a", steps=2)
    assert engine.optimize("a", 100).w == pytest.approx(engine.dataset("a")["w"])
    assert engine.stats("a")["total_points"] == 300
    engine.save("a", f"file://{tmp_path}/saved")
    assert engine.load(f"file://{tmp_path}/saved", "copy") == "copy"
    assert engine.points("copy").count() == 300
    assert engine.codebook("copy") == engine.codebook("a")
    assert [r.name for r in engine.list_datasets().collect()] == ["copy", "a"]
    with pytest.raises(Exception, match="expected 8 numbers"):
        engine.ingest("a", spark.createDataFrame([(1, [1.0])], "id long, v array<double>"))
    engine.drop_dataset("copy")
    with pytest.raises(KeyError):
        engine.points("copy")


def test_catalog_survives_an_interrupted_and_a_second_writer(spark, tmp_path, monkeypatch):
    import threading

    engine = Engine(spark, f"file://{tmp_path}/engine")
    engine.create_dataset("a", 2)
    (tmp_path / "engine/datasets/data-lost").mkdir()  # a writer lost while it wrote its table
    entry = tmp_path / "engine/datasets/log/000000000001"
    entry.touch()  # and one lost before it filled its entry
    os.utime(entry, (1, 1))
    engine.create_dataset("b", 2)
    assert sorted(r.name for r in engine.datasets().collect()) == ["a", "b"]
    failed = []

    def add(k):
        try:
            Engine(spark, engine.folder).create_dataset(f"c{k}", 2)
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert sorted(r.name for r in engine.datasets().collect()) == ["a", "b", "c0", "c1", "c2", "c3"]


def test_index_and_codes_are_stored_and_grow(spark, tmp_path, cloud):
    engine = Engine(spark, f"file://{tmp_path}/engine")
    engine.create_dataset("a", 8, w=4.0, k=2, sampling_ratio=1.0, quantization_method="hybrid", pq_num_subspaces=4, pq_num_clusters=16)
    engine.ingest("a", cloud.where("id < 20"), "one")
    assert not engine._versions("codebooks/a")  # too few points yet
    runs = lambda kind: sorted(p.name for p in (tmp_path / f"engine/{kind}/a").glob("*/run-*"))
    first = runs("index")
    assert len(first) == 1
    engine.ingest("a", cloud.where("id >= 20 AND id < 200"), "two")
    assert engine._versions("codebooks/a")  # trained on ingest
    assert set(first) < set(runs("index"))
    engine.ingest("a", cloud.where("id >= 200"), "two")  # replaces the second batch
    assert len(runs("index")) == 3
    live = cloud.where("id < 20 OR id >= 200").select("id", "v")
    rows = lambda d: sorted(tuple(r) for r in d.select("id", "table_id", "bucket_key").collect())
    assert rows(engine.index("a")) == rows(ann.build_index(live, engine.family("a")))
    assert engine.codes("a").count() == 120
    before = runs("index") + runs("codes")
    asked = cloud.where("id < 5").select(F.col("id").alias("q_id"), "v")
    assert engine.query("a", asked, 3).count() == 15
    assert runs("index") + runs("codes") == before  # queries make nothing anew
    names = {r.batch_id: r.features_hash for r in engine.batches().collect()}
    shuffled = Engine(spark, f"file://{tmp_path}/other")
    shuffled.create_dataset("a", 8)
    shuffled.ingest("a", cloud.where("id >= 200").repartition(5), "two")
    assert shuffled.batches().first().features_hash == names["two"] != names["one"]
    assert len(names["two"]) == 64
    assert re.fullmatch(r"batch_[0-9a-f]{16}_\d{8}_\d{6}", shuffled.ingest("a", cloud.where("id < 9")))


def test_compressed_codebook_is_stored_with_its_maps(spark, tmp_path, cloud):
    engine = Engine(spark, f"file://{tmp_path}/engine")
    engine.create_dataset("a", 8, quantization_method="pq", pq_num_subspaces=4, pq_num_clusters=16)
    engine.ingest("a", cloud, "one")
    old = engine.codebook("a")
    assert engine.compression("a") == {"ratio": old.ratio(300), "maps": None}
    small = engine.compress_pq("a", threshold=0.8)
    maps = engine.compression("a")["maps"]
    assert sum(map(len, small.centroids)) < sum(map(len, old.centroids))
    assert [max(m) + 1 for m in maps] == [len(c) for c in small.centroids]
    assert engine.codebook("a") == small
    assert engine.codes("a").agg(F.max(F.array_max("pq_code"))).first()[0] < max(map(len, small.centroids))
    assert engine.compression("a")["ratio"] == small.ratio(300, maps=maps)


def test_adaptive_search_uses_the_tuned_radius(spark, tmp_path, cloud):
    engine = Engine(spark, f"file://{tmp_path}/engine")
    engine.create_dataset("a", 8, w=0.05, k=3, sampling_ratio=1.0, initial_radius=8.0, radius_expansion=3.0)
    engine.ingest("a", cloud, "one")
    asked = cloud.where("id < 20").select(F.col("id").alias("q_id"), "v")
    found = engine.candidates("a", asked, 5, exclude_self=True)
    plain = ann.adaptive_candidates(cloud, asked, engine.family("a"), 5, levels=1)
    assert found.count() > plain.count()
    assert found.agg(F.max("level")).first()[0] > 0
    truth = ann.exact_knn(cloud, asked, 5)
    assert ann.overlap(truth, engine.query("a", asked, 5, exclude_self=True), 5).first().recall > ann.overlap(truth, engine.query("a", asked, 5, exclude_self=True, levels=1), 5).first().recall


def test_diffusion_is_applied_to_points_and_queries(spark, tmp_path, cloud):
    engine = Engine(spark, f"file://{tmp_path}/engine")
    engine.create_dataset("a", 8, quantization_method="pq", pq_num_subspaces=4, pq_num_clusters=32)
    engine.ingest("a", cloud, "one")
    asked = cloud.where("id < 60").select(F.col("id").alias("q_id"), "v")
    engine.train_pq("a", diffusion=True)
    book, map_ = engine._quantizer("a")
    assert book.dim == 4
    assert np.allclose(map_.coordinates, type(map_).from_json(map_.to_json()).coordinates)
    turned = cloud.select("id", map_.extend()("v").alias("v"))
    codes = turned.select("id", book.encode_arrow()("v").alias("pq_code"))
    assert sorted((r.id, *r.pq_code) for r in engine.codes("a").collect()) == sorted((r.id, *r.pq_code) for r in codes.collect())
    found = engine.query("a", asked, 10, exclude_self=True)
    # The map draws each cloud together: neighbours are of the own cloud, though seldom the very nearest.
    both = found.join(cloud.select("id", "label"), "id").join(cloud.select(F.col("id").alias("q_id"), F.col("label").alias("own")), "q_id")
    assert both.agg(F.avg((F.col("label") == F.col("own")).cast("double"))).first()[0] > 0.9
    engine.save("a", f"file://{tmp_path}/saved")
    engine.load(f"file://{tmp_path}/saved", "copy")
    assert sorted(map(tuple, engine.query("copy", asked, 10, exclude_self=True).collect())) == sorted(map(tuple, found.collect()))


def test_stream_into_the_catalog(spark, tmp_path, cloud):
    cloud.select("id", "v").repartition(3).write.parquet(f"file://{tmp_path}/in")
    engine = Engine(spark, f"file://{tmp_path}/engine")
    engine.create_dataset("s", 8)
    stream = ingest.read_stream(spark, f"file://{tmp_path}/in")
    ingest.ingest_stream(engine, "s", stream, f"file://{tmp_path}/cp").awaitTermination()
    assert engine.points("s").count() == 300
    assert engine.batches().count() == 3
    model = kmeans.KMeans(3)
    ingest.cluster_stream(model, ingest.read_stream(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/cp2").awaitTermination()
    assert model.counts.sum() == 300


def test_wide_and_json_sources(spark, tmp_path, cloud):
    sources.write_wide(cloud, f"file://{tmp_path}/wide", 8, label="label")
    assert len(sources.read_wide(spark, f"file://{tmp_path}/wide").first().v) == 8
    (tmp_path / "b.json").write_text('{"dataset_name": "d", "batch_id": "x", "data": [[1, 2], [3, 4]]}\n')
    assert sources.read_json_batches(spark, f"file://{tmp_path}/b.json").count() == 2
    for made in (sources.circles(spark, 10, extra=2), sources.moons(spark, 10, extra=2)):
        assert all(len(r.v) == 4 for r in made.collect())


def test_generated_shapes(spark):
    both = sources.mixed(spark, 101, extra=3)
    assert both.count() == 101 and both.select("id").distinct().count() == 101
    assert {r.label for r in both.select("label").distinct().collect()} == {0, 1, 2, 3}
    assert both.where("size(v) <> 5").isEmpty()
    rings = np.array([r.v[:2] for r in both.where("label >= 2").collect()]) - 5
    assert set(np.round(np.linalg.norm(rings, axis=1) / 2.5).astype(int).tolist()) == {1, 2}
    x = np.array([r.v for r in sources.anisotropic(spark, 300, centres=1).collect()])
    values = np.linalg.eigvalsh(np.cov(x.T))
    assert values[1] > 5 * values[0]


def test_distances_by_name(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    got = {m: row.select(vectors.distance(m)(F.col("a"), F.col("b"))).first()[0] for m in vectors.METRICS}
    assert got == pytest.approx({"euclidean": 2**0.5, "manhattan": 2.0, "cosine": 1.0, "hamming": 1.0})
    with pytest.raises(ValueError):
        vectors.distance("none")


def test_salted_ranks_are_the_plain_ones(spark):
    rows = spark.range(2000).withColumn("k", (F.col("id") > 5).cast("int"))
    got = {(r.k, r.id) for r in sampling.first_of(rows, F.lit(7), ["k"], 3).collect()}
    plain = rows.toPandas()
    import hashlib

    plain["h"] = [hashlib.md5(f"3|{i}".encode()).hexdigest() for i in plain.id]
    assert got == {(r.k, r.id) for _, g in plain.sort_values("h").groupby("k") for r in g.head(7).itertuples()}


def test_principal_components(cloud, local):
    x, _ = local
    values, directions = np.linalg.eigh(np.cov(x.T))
    top = projection.components(cloud, 8, 2)
    assert np.allclose(np.abs(top @ directions[:, ::-1][:, :2]), np.eye(2), atol=1e-6)
    row = projection.compare_training(cloud, 8, 3, count=3, steps=3).first()
    assert row.reduced_inertia <= row.full_inertia * 1.5
    assert row.agreement > 0.5


def test_report(spark, tmp_path):
    report = Report().add("pq", recall=0.5, mse=1.0).add("a<b", accuracy=0.25)
    assert {(r.name, r.accuracy, r.recall) for r in report.table(spark).collect()} == {("pq", 0.5, 0.5), ("a<b", 0.25, 0.25)}
    assert "a&lt;b" in report.html(spark)
    report.write_json(spark, f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").count() == 2
    with pytest.raises(ValueError):
        report.add("x", speed=1.0)


def test_importance_sample_is_whole_when_a_bucket_dominates(spark):
    rows = spark.range(2000).selectExpr("id", "if(id < 1900, 0, id % 10 + 1) AS k", "cast(id % 7 AS double) AS f")
    for strategy in ("proportional", "balanced", "variance"):
        got = sampling.importance_sample(rows, "k", F.col("f"), 60, strategy, temperature=0.01)
        assert got.select("id").distinct().count() == got.count() == 60


def test_sweep_scores_all_points(spark):
    points = sources.blobs(spark, 1300, dim=4, centres=3, spread=2.0).select("id", "v").cache()
    row = metrics.k_sweep(points, [3], steps=2)[0]
    rows = kmeans.assigned(points, np.array(kmeans.lloyd(points, 3, 2, 0)))
    assert row["silhouette_mean"] == pytest.approx(metrics.silhouette(rows).first()[0], abs=1e-9)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
@pytest.mark.parametrize("probes", [1, 4])
def test_hash_search_in_blocks_agrees_with_candidates(spark, metric, probes, monkeypatch):
    """Once every candidate was a row, and joined with both vectors. Here with few and with many candidates, many copies, blocks
    that hold less than k, one after another."""
    monkeypatch.setattr(nearest, "POINTS", 64)
    monkeypatch.setattr(nearest, "QUERIES", 16)
    monkeypatch.setattr(nearest, "STRIP", 8)
    monkeypatch.setattr(nearest, "MEASURED", 50)
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(300, 8)), np.zeros((2, 8))])
    x[100:190] = x[20]
    x[200:203] = x[20] + 1e-9
    odd = [(900, None), (940, [1.0, None, *[0.0] * 6]), (980, [1.0, 2.0]), (None, x[0].tolist())]
    points = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *odd], "id long, v array<double>").repartition(3)
    whole = points.where("id < 900")
    q = points.where("id % 20 = 0").select(F.col("id").alias("q_id"), "v")
    for width in (0.4, 6.0):
        f = HashFamily.draw(8, 3, 2 if metric == "cosine" and width > 1 else 4, width, metric)
        asked = q.where("q_id < 900")
        want = ann.rerank(ann.candidates(asked, ann.build_index(whole, f), f, probes), whole, asked, 12, metric)
        got = ann.hash_knn(points, q, f, 12, probes)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_numbers_of_blocks_are_those_of_columns(spark, metric):
    x = np.random.default_rng(12).normal(size=(200, 64))
    f = HashFamily.draw(64, 3, 2, 0.01, metric)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    rows_ = points.select("id", f.bins(F.col("v")).alias("bins"), vectors.distance(metric)(F.lit(x[0].tolist()), F.col("v")).alias("d")).orderBy("id").collect()
    assert [r.bins for r in rows_] == f.bins_rows(x).tolist()
    assert [r.d for r in rows_] == nearest.measured(np.tile(x[0], (200, 1)), x, metric).tolist()


def test_hash_search_makes_no_row_of_a_candidate(spark):
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "id long, v array<double>")
    f = HashFamily.draw(2, 2, 1, 100.0)
    plan = ann.hash_knn(points, points.withColumnRenamed("id", "q_id"), f, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket_key" not in plan and "Generate" not in plan and "Join" in plan
