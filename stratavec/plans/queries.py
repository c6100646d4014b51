"""Registered queries of the vector operators and the same results in SQL.

Points are all rows of embeddings; where queries are needed, they are the rows whose vec_id is divisible by 20. Results
are rounded to six digits. Hash families and codebooks are stated in the SQL as literals or as steps of their own."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.hashing import HashFamily, MultiWidth, bucket_key, collision_column
from ..operators import ann, dbscan, estimators, gradient, kmeans, metrics, pq, projection, sampling, tuning
from ..operators import importance as importance_ops
from ..sources import catalog
from ..sources.scratch import keep, new_path
from ..sources.vectors import read_packed, read_wide, write_wide

DIM, K, SEED = 64, 10, 42
FAMILY = HashFamily.draw(DIM, tables=4, hashes=2, width=0.5)
COSINE = HashFamily.draw(DIM, tables=4, hashes=6, metric="cosine")
#: Families of the search queries. The vectors of the tables have no structure, neighbours are hardly nearer than others,
#: so a recall of 0.9 takes wide buckets, and most points as candidates.
WIDE = HashFamily.draw(DIM, tables=6, hashes=2, width=2.0)
PROBED = HashFamily.draw(DIM, tables=12, hashes=3, width=1.5)
PROBED_COSINE = HashFamily.draw(DIM, tables=8, hashes=4, metric="cosine")
MANHATTAN = HashFamily.draw(DIM, tables=3, hashes=2, width=20.0, metric="manhattan")
FAST = HashFamily.draw(DIM, tables=3, hashes=2, width=0.5, ratio=0.5)
WIDTHS = MultiWidth.draw(DIM, 3, [0.25, 0.5, 1.0])
CAUCHY = MultiWidth.draw(DIM, 3, [2.0, 4.0], kind="cauchy_mad")
SUBSPACES, CODES, STEPS, CLUSTERS = 4, 8, 2, 5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packed(spark, f"{sf_dir}/embeddings.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), vectors.doubles("embedding").alias("v"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("id % 20 = 0").withColumnRenamed("id", "q_id")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


#: Rows of all vectors, and of the queries.
E = "e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT id AS q_id, v AS qv FROM e WHERE id % 20 = 0)"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([E, *parts]) + "\n"


def top(source: str, k: int = K) -> str:
    return f"SELECT q_id, rn, id, round(dist, 6) AS dist FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY dist, id) AS INTEGER) AS rn FROM {source}) WHERE rn <= {k}"


def index_sql(f: HashFamily, radius: float = 1.0, name: str = "idx") -> str:
    a, b = json.dumps(f.a), json.dumps(f.b)
    value = "CAST(list_dot_product(v, a) > 0 AS INTEGER)" if f.metric == "cosine" else f"CAST(floor((list_dot_product(v, a) + b) / {f.width * radius!r}) AS INTEGER)"
    return (
        f"{name}_p AS (SELECT unnest(CAST({a} AS DOUBLE[][])) AS a, unnest(CAST({b} AS DOUBLE[])) AS b, unnest(range({len(f.b)})) AS h),\n"
        f"{name}_b AS (SELECT id, CAST(h // {f.hashes} AS INTEGER) AS table_id, h % {f.hashes} AS j, {value} AS bin FROM e, {name}_p),\n"
        f"{name} AS (SELECT id, table_id, string_agg(CAST(bin AS VARCHAR), '|' ORDER BY j) AS bucket_key FROM {name}_b GROUP BY id, table_id)"
    )


# -- exact search and hash keys -------------------------------------------------------------------------------------


def _knn(metric: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(ann.exact_knn(points(spark, sf_dir), asked(spark, sf_dir), K, metric), "dist")

    run.__name__ = f"knn_{metric}"
    query(with_(f"d AS (SELECT q_id, id, {sql} AS dist FROM q, e WHERE q_id <> id)") + top("d"))(run)


_knn("euclidean", "list_distance(qv, v)")
_knn("manhattan", "list_sum(list_transform(list_zip(qv, v), lambda z: abs(z[1] - z[2])))")
_knn("cosine", "1 - list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v)))")


def _keys(name: str, family: HashFamily) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ann.build_index(points(spark, sf_dir), family)

    run.__name__ = name
    query(with_(index_sql(family)) + "SELECT * FROM idx")(run)


_keys("lsh_keys_euclidean", FAMILY)
_keys("lsh_keys_cosine", COSINE)
_keys("lsh_keys_manhattan", MANHATTAN)
_keys("fastlsh_keys", FAST)


def _widths(name: str, family: MultiWidth) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        both = points(spark, sf_dir).select("id", family.bins(F.col("v")).alias("s"))
        return both.select("id", *[bucket_key(F.col(f"s.bins_{i}")).alias(f"bins_{i}") for i in range(len(family.widths))])

    run.__name__ = name
    bins = ", ".join(f"string_agg(CAST(CAST(floor(list_dot_product(v, a) / {w!r}) AS INTEGER) AS VARCHAR), '|' ORDER BY h) AS bins_{i}" for i, w in enumerate(family.widths))
    query(with_(f"p AS (SELECT unnest(CAST({json.dumps(family.a)} AS DOUBLE[][])) AS a, unnest(range({len(family.a)})) AS h)") + f"SELECT id, {bins} FROM e, p GROUP BY id")(run)


_widths("lsh_multi_width", WIDTHS)
_widths("lsh_multi_width_cauchy", CAUCHY)


@query(with_(index_sql(FAMILY)) + "SELECT table_id, bucket_key, count(*) AS bucket_size FROM idx GROUP BY 1, 2")
def lsh_bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.bucket_sizes(ann.build_index(points(spark, sf_dir), FAMILY))


@query(with_(index_sql(FAMILY)) + "SELECT table_id, count(*) AS n_points, count(DISTINCT bucket_key) AS n_buckets FROM idx GROUP BY 1")
def lsh_table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.table_stats(ann.build_index(points(spark, sf_dir), FAMILY))


@query(with_(index_sql(FAMILY)) + "SELECT table_id, bucket_key AS hash_value, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS point_indices FROM idx GROUP BY 1, 2")
def lsh_tables_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = ann.materialised_tables(ann.build_index(points(spark, sf_dir), FAMILY))
    return tables.withColumn("point_indices", F.concat_ws(",", F.transform("point_indices", lambda x: x.cast("string"))))


CANDIDATES = "cand AS (SELECT DISTINCT a.id AS q_id, b.id FROM idx a JOIN idx b USING (table_id, bucket_key) WHERE a.id % 20 = 0 AND a.id <> b.id)"
RANKED = "d AS (SELECT cand.q_id, cand.id, list_distance(qv, v) AS dist FROM cand JOIN q USING (q_id) JOIN e USING (id))"


@query(with_(index_sql(FAMILY), CANDIDATES) + "SELECT * FROM cand")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return ann.candidates(asked(spark, sf_dir), ann.build_index(p, FAMILY), FAMILY).where("q_id <> id")


@query(with_(index_sql(WIDE), CANDIDATES, RANKED) + top("d"))
def lsh_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return rounded(ann.hash_knn(p, asked(spark, sf_dir), WIDE, K), "dist")


def probe_sql(f: HashFamily, probes: int) -> str:
    value = "abs(bin - d)" if f.metric == "cosine" else "bin + d"
    return (
        f"deltas AS (SELECT unnest(CAST({json.dumps(f.probe_deltas(probes))} AS INTEGER[][])) AS ds, unnest(range({len(f.probe_deltas(probes))})) AS probe),\n"
        f"pk AS (SELECT id AS q_id, table_id, probe, string_agg(CAST({value.replace('d)', 'ds[j + 1])').replace('+ d', '+ ds[j + 1]')} AS VARCHAR), '|' ORDER BY j) AS bucket_key FROM idx_b, deltas WHERE id % 20 = 0 GROUP BY ALL),\n"
        "cand AS (SELECT DISTINCT q_id, idx.id FROM pk JOIN idx USING (table_id, bucket_key) WHERE q_id <> idx.id)"
    )


@query(with_(index_sql(PROBED), probe_sql(PROBED, 5), RANKED) + top("d"))
def lsh_knn_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return rounded(ann.hash_knn(p, asked(spark, sf_dir), PROBED, K, probes=5), "dist")


@query(
    with_(index_sql(PROBED_COSINE), probe_sql(PROBED_COSINE, 4), "d AS (SELECT cand.q_id, cand.id, 1 - list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))) AS dist FROM cand JOIN q USING (q_id) JOIN e USING (id))")
    + top("d")
)
def lsh_knn_cosine_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return rounded(ann.hash_knn(p, asked(spark, sf_dir), PROBED_COSINE, K, probes=4), "dist")


_LEVELS = 5


@query(
    with_(
        *[index_sql(FAMILY, 2.0**i, f"i{i}") for i in range(_LEVELS)],
        "lv AS (" + " UNION ALL ".join(f"SELECT DISTINCT a.id AS q_id, b.id, {i} AS level FROM i{i} a JOIN i{i} b USING (table_id, bucket_key) WHERE a.id % 20 = 0 AND a.id <> b.id" for i in range(_LEVELS)) + ")",
        "n AS (SELECT q_id, level, count(*) AS n FROM lv GROUP BY 1, 2)",
        f"c AS (SELECT q_id, coalesce(min(CASE WHEN n >= {3 * 5} THEN level END), max(level)) AS level FROM n GROUP BY 1)",
    )
    + "SELECT lv.q_id, lv.id, lv.level FROM lv JOIN c USING (q_id, level)"
)
def lsh_adaptive_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.adaptive_candidates(points(spark, sf_dir), asked(spark, sf_dir), FAMILY, k=5, levels=_LEVELS)


def lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of multi-probe search against exact search."""
    p, q = points(spark, sf_dir), asked(spark, sf_dir)
    found = ann.hash_knn(p, q, PROBED, K, probes=5)
    return rounded(ann.overlap(ann.exact_knn(p, q, K), found, K), "recall")


query(
    with_(
        index_sql(PROBED), probe_sql(PROBED, 5), RANKED,
        "t AS (SELECT q_id, id, list_distance(qv, v) AS dist FROM q, e WHERE q_id <> id)",
        f"a AS ({top('t')}), b AS ({top('d')})",
    )
    + f"SELECT round(avg(r), 6) AS recall FROM (SELECT a.q_id, count(b.id) / CAST({K} AS DOUBLE) AS r FROM a LEFT JOIN b ON a.q_id = b.q_id AND a.id = b.id GROUP BY 1)"
)(lsh_recall)


# -- density, stratified and importance samples ---------------------------------------------------------------------

#: Points with the key of the first table and the target that samples are drawn for.
KEYED = "k AS (SELECT e.id, v, bucket_key AS bucket, sqrt(list_dot_product(list_slice(v, 1, 8), list_slice(v, 1, 8))) AS f FROM e JOIN idx ON e.id = idx.id WHERE table_id = 0)"
MD5 = "md5('42|' || {})"
U = "CAST(CAST('0x' || substr(md5('{}|' || {}), 1, 8) AS BIGINT) / 4294967296 AS DOUBLE)"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumns({"bucket": bucket_key(FAMILY.table_bins(F.col("v"), 0)), "f": vectors.norm(vectors.sub_vector(F.col("v"), 0, 8))})


@query(with_(index_sql(FAMILY), KEYED) + "SELECT id, bucket AS bucket_key, count(*) OVER (PARTITION BY bucket) AS bucket_size, round(1 / (count(*) OVER (PARTITION BY bucket) + 1e-10), 6) AS weight FROM k")
def density_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ann.with_density(points(spark, sf_dir), bucket_key(FAMILY.table_bins(F.col("v"), 0))).select("id", "bucket_key", "bucket_size", "weight"), "weight")


@query(
    with_(
        index_sql(FAMILY), KEYED, "w AS (SELECT id, bucket, 1 / (count(*) OVER (PARTITION BY bucket) + 1e-10) AS weight FROM k)",
        "b AS (SELECT bucket, sum(weight) AS w, count(*) AS c FROM w GROUP BY 1)",
    )
    + f"SELECT w.id FROM w JOIN b USING (bucket) WHERE {U.format(42, 'id')} < least(1.0, b.w / (SELECT sum(w) FROM b) * 100 / c)"
)
def density_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = ann.with_density(points(spark, sf_dir), bucket_key(FAMILY.table_bins(F.col("v"), 0)))
    return sampling.density_sample(weighted, "bucket_key", "weight", 100).select("id")


DRAWN = "r AS (SELECT k.id, qt.*, row_number() OVER (PARTITION BY k.bucket ORDER BY md5('42|' || k.id), k.id) AS rk FROM k JOIN qt USING (bucket))"
STRATIFIED = "SELECT id, round(1 / (p * n / size), 6) AS weight, round(CAST(size AS DOUBLE) / n, 6) AS weight_ht FROM r WHERE rk <= n"


@query(
    with_(
        index_sql(FAMILY), KEYED, "s AS (SELECT bucket, count(*) AS size, 100 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM k GROUP BY 1)",
        "o AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, bucket) AS place, 100 - sum(floor(share)) OVER () AS left_over FROM s)",
        "qt AS (SELECT bucket, size, p, least(floor(share) + CAST(place <= left_over AS INTEGER), size) AS n FROM o)", DRAWN,
    )
    + STRATIFIED
)
def sample_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.stratified(keyed(spark, sf_dir), "bucket", 100), "weight", "weight_ht")


@query(
    with_(
        index_sql(FAMILY), KEYED, "s AS (SELECT bucket, count(*) AS size, count(*) OVER () AS c FROM k GROUP BY 1)",
        "o AS (SELECT bucket, size, 1 / CAST(c AS DOUBLE) AS p, least(floor(100 / CAST(c AS DOUBLE)), size) AS base FROM s)",
        "o2 AS (SELECT *, 100 - sum(base) OVER () AS left_over, coalesce(sum(CAST(base < size AS INTEGER)) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)",
        "qt AS (SELECT bucket, size, p, base + CASE WHEN base < size AND before < left_over THEN 1 ELSE 0 END AS n FROM o2)", DRAWN,
    )
    + STRATIFIED
)
def sample_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.stratified(keyed(spark, sf_dir), "bucket", 100, "balanced"), "weight", "weight_ht")


@query("SELECT vec_id AS id FROM embeddings ORDER BY md5('42|' || vec_id), vec_id LIMIT 100")
def sample_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform_sample(points(spark, sf_dir).select("id"), 100)


@query("SELECT event_id AS id FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 1000")
def reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.reservoir(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id")), 1000)


def _weighted(name: str, method: str, order: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sampling.weighted_sample(keyed(spark, sf_dir).select("id", "f"), F.col("f"), 100, method=method).select("id")

    run.__name__ = name
    query(with_(index_sql(FAMILY), KEYED) + f"SELECT id FROM k ORDER BY {order}, id LIMIT 100")(run)


_weighted("sample_weighted", "ratio", f"{U.format(42, 'id')} / f")
_weighted("sample_weighted_es", "es", f"pow({U.format(42, 'id')}, 1 / f) DESC")

IMPORTANCE = {"proportional": "CAST(size AS DOUBLE)", "balanced": "CAST(least(size, 10) AS DOUBLE)", "variance": "var * size"}


def importance_sql(strategy: str) -> str:
    return with_(
        index_sql(FAMILY), KEYED,
        "s AS (SELECT bucket, count(*) AS size, coalesce(var_samp(f), 0) AS var FROM k GROUP BY 1)",
        f"i AS (SELECT bucket, size, {IMPORTANCE[strategy]} AS imp, sum(size) OVER () AS total FROM s)",
        "x AS (SELECT *, coalesce(imp / nullif(sum(imp) OVER (), 0), 0) AS part, exp((imp - max(imp) OVER ()) / 5.0) AS ex FROM i)",
        "p AS (SELECT *, ex / sum(ex) OVER () AS p FROM x)",
        "g AS (SELECT *, least(ceil(p * 100), size, 10) AS quota FROM p)",
        "q0 AS (SELECT bucket, size, part, total, p, greatest(0, least(quota, 100 - coalesce(sum(quota) OVER (ORDER BY p DESC, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS n FROM g)",
        "tu AS (SELECT bucket, size, part, total, greatest(0, least(size, (SELECT 100 - sum(n) FROM q0) - coalesce(sum(size) OVER (ORDER BY p DESC, size DESC, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS n FROM q0 WHERE n = 0)",
        "qt AS (SELECT bucket, size, part, total, n FROM q0 WHERE n > 0 UNION ALL SELECT bucket, size, part, total, n FROM tu WHERE n > 0)", DRAWN,
        "z AS (SELECT id, bucket, coalesce(1 / nullif(part * n / size * total, 0), 1.0) AS weight FROM r WHERE rk <= n)",
    )


def importance(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    return sampling.importance_sample(keyed(spark, sf_dir), "bucket", F.col("f"), 100, strategy, temperature=5.0)


def _importance(strategy: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(importance(spark, sf_dir, strategy), "weight")

    run.__name__ = f"lsh_importance_{strategy}"
    query(importance_sql(strategy) + "SELECT id, bucket, round(weight, 6) AS weight FROM z")(run)


for _strategy in IMPORTANCE:
    _importance(_strategy)


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(spark, sf_dir, "proportional").join(keyed(spark, sf_dir).select("id", "v", "f"), "id")


@query(importance_sql("proportional") + "SELECT round(sum(weight * f) / sum(weight), 6) AS expectation FROM z JOIN k USING (id)")
def is_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.expectation(drawn(spark, sf_dir), F.col("f")), "expectation")


@query(importance_sql("proportional") + "SELECT round(sum(weight * pow(f - mu, 2)) / sum(weight), 6) AS variance FROM z JOIN k USING (id), (SELECT sum(weight * f) / sum(weight) AS mu FROM z JOIN k USING (id))")
def is_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.variance(drawn(spark, sf_dir), F.col("f")), "variance")


@query(importance_sql("proportional") + "SELECT round(pow(sum(weight), 2) / sum(weight * weight), 6) AS ess FROM z")
def is_effective_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.effective_size(importance(spark, sf_dir, "proportional")), "ess")


def _cov(table: str, name: str) -> str:
    return f"{name} AS (SELECT i, j, covar_samp(v[i], v[j]) AS cov FROM {table}, range(1, {DIM + 1}) AS a(i), range(1, {DIM + 1}) AS b(j) GROUP BY 1, 2)"


@query(
    importance_sql("proportional").rstrip()
    + ",\nsm AS (SELECT e.id, v FROM e JOIN z ON e.id = z.id), "
    + _cov("e", "ca")
    + ", "
    + _cov("sm", "cb")
    + f", ma AS (SELECT i, avg(v[i]) AS m FROM e, range(1, {DIM + 1}) AS a(i) GROUP BY 1), mb AS (SELECT i, avg(v[i]) AS m FROM sm, range(1, {DIM + 1}) AS a(i) GROUP BY 1)"
    + " SELECT round((SELECT sqrt(sum(pow(ma.m - mb.m, 2))) FROM ma JOIN mb USING (i)), 6) AS mean_diff, round((SELECT sqrt(sum(pow(ca.cov - cb.cov, 2))) FROM ca JOIN cb USING (i, j)), 6) AS cov_diff"
)
def is_distribution_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.compare(points(spark, sf_dir), drawn(spark, sf_dir)), "mean_diff", "cov_diff")


# -- Lloyd steps and product quantization ---------------------------------------------------------------------------


def lloyd_sql(parts: int, k: int, steps: int, name: str) -> str:
    """Centres {name}c(m, code, x) after steps, from the hash-first rows, for parts equal slices; {name}s(id, m, x)."""
    n = DIM // parts
    out = [f"{name}s AS (SELECT id, m, list_slice(v, m * {n} + 1, m * {n} + {n}) AS x FROM e, range({parts}) AS t(m))"]
    out.append(f"{name}c0 AS (SELECT m, code, x FROM {name}s JOIN (SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS code FROM e) USING (id) WHERE code < {k})")
    for step in range(steps):
        out.append(f"{name}a{step} AS (SELECT s.id, s.m, s.x, c.code FROM {name}s s JOIN {name}c{step} c ON s.m = c.m QUALIFY row_number() OVER (PARTITION BY s.id, s.m ORDER BY list_distance(s.x, c.x), c.code) = 1)")
        out.append(f"{name}u{step} AS (SELECT m, code, list(a ORDER BY i) AS x FROM (SELECT m, code, i, avg(x[i]) AS a FROM {name}a{step}, range(1, {n + 1}) AS t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
        out.append(f"{name}c{step + 1} AS (SELECT o.m, o.code, coalesce(u.x, o.x) AS x FROM {name}c{step} o LEFT JOIN {name}u{step} u ON o.m = u.m AND o.code = u.code)")
    out.append(f"{name}c AS (SELECT * FROM {name}c{steps})")
    out.append(f"{name}l AS (SELECT s.id, s.m, s.x, c.code, list_distance(s.x, c.x) AS dist, c.x AS cx FROM {name}s s JOIN {name}c c ON s.m = c.m QUALIFY row_number() OVER (PARTITION BY s.id, s.m ORDER BY list_distance(s.x, c.x), c.code) = 1)")
    return ",\n".join(out)


BOOK_SQL = lloyd_sql(SUBSPACES, CODES, STEPS, "p")
CODED = "coded AS (SELECT id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY m) AS pq_code FROM pl GROUP BY 1)"
DECODED = "dec AS (SELECT id, flatten(list(cx ORDER BY m)) AS r FROM pl GROUP BY 1)"


def book(spark: SparkSession, sf_dir: str) -> pq.Codebook:
    return pq.train(points(spark, sf_dir), DIM, SUBSPACES, CODES, STEPS, SEED)


def coded(spark: SparkSession, sf_dir: str, b: pq.Codebook) -> DataFrame:
    return points(spark, sf_dir).select("id", "v", b.encode(F.col("v")).alias("pq_code"))


def _text(code: str = "pq_code") -> F.Column:
    return F.concat_ws(",", F.transform(code, lambda c: c.cast("string")))


@query(with_(BOOK_SQL, CODED) + "SELECT * FROM coded")
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir, book(spark, sf_dir)).select("id", _text().alias("pq_code"))


@query(with_(BOOK_SQL) + "SELECT CAST(m AS INTEGER) AS subspace, CAST(code AS INTEGER) AS code, round(x[i], 6) AS value, CAST(i - 1 AS INTEGER) AS pos FROM pc, range(1, 17) AS t(i)")
def pq_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book(spark, sf_dir).table(spark).select("subspace", "code", F.posexplode("centroid").alias("pos", "value")), "value")


@query(with_(BOOK_SQL, DECODED) + f"SELECT round(avg(d2), 6) AS mse_row, round(avg(d2) / {DIM}, 6) AS mse_element FROM (SELECT pow(list_distance(v, r), 2) AS d2 FROM e JOIN dec USING (id))")
def pq_decode_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pq.reconstruction_error(points(spark, sf_dir), book(spark, sf_dir)), "mse_row", "mse_element")


ADC = "d AS (SELECT q.q_id, pl.id, {} AS dist FROM q, pl JOIN pc ON pl.m = pc.m AND pl.code = pc.code WHERE q_id <> id GROUP BY 1, 2)"
_PART = "list_distance(list_slice(qv, pl.m * 16 + 1, pl.m * 16 + 16), pc.x)"


def _adc(name: str, squared: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = book(spark, sf_dir)
        return rounded(pq.search(coded(spark, sf_dir, b), asked(spark, sf_dir), b, K, squared), "dist").select("q_id", "rn", "dist")

    run.__name__ = name
    # Points with one code are equally far, and sums in another order differ in the last bit, so ids aren't compared.
    query(with_(BOOK_SQL, ADC.format(f"sqrt(sum(pow({_PART}, 2)))" if squared else f"sum({_PART})")) + "SELECT q_id, rn, dist FROM (" + top("d") + ")")(run)


_adc("pq_adc_root_of_squares", True)
_adc("pq_adc_sum", False)


@query(
    with_(index_sql(FAMILY), CANDIDATES, BOOK_SQL, DECODED, "d AS (SELECT cand.q_id, cand.id, list_distance(a.r, b.r) AS dist FROM cand JOIN dec a ON a.id = cand.q_id JOIN dec b ON b.id = cand.id)")
    + "SELECT q_id, rn, dist FROM ("
    + top("d")
    + ")"
)
def pq_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q, b = points(spark, sf_dir), asked(spark, sf_dir), book(spark, sf_dir)
    found = ann.candidates(q, ann.build_index(p, FAMILY), FAMILY).where("q_id <> id")
    return rounded(pq.rerank_codes(found, coded(spark, sf_dir, b), q, b, K), "dist").select("q_id", "rn", "dist")


@query(with_(BOOK_SQL) + "SELECT CAST(m AS INTEGER) AS subspace, CAST(code AS INTEGER) AS code, count(*) AS count FROM pl GROUP BY 1, 2")
def pq_code_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.code_stats(coded(spark, sf_dir, book(spark, sf_dir)))


@query(with_(BOOK_SQL) + "SELECT CAST(pc.m AS INTEGER) AS subspace, CAST(pc.code AS INTEGER) AS code, round(count(pl.id) / CAST((SELECT count(*) FROM e) AS DOUBLE), 6) AS importance FROM pc LEFT JOIN pl ON pc.m = pl.m AND pc.code = pl.code GROUP BY 1, 2")
def pq_code_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = book(spark, sf_dir)
    return rounded(pq.code_importance(coded(spark, sf_dir, b), b), "importance")


@query(
    with_(BOOK_SQL, DECODED, "b AS (SELECT id, v, r FROM e JOIN dec USING (id))", "d AS (SELECT list_distance(x.v, y.v) AS d, list_distance(x.r, y.r) AS e FROM b x JOIN b y ON y.id BETWEEN x.id + 1 AND x.id + 9)")
    + "SELECT round(corr(d, e), 6) AS correlation, round(avg(abs(d - e) / (d + 1e-10)), 6) AS mape FROM d"
)
def pq_distance_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pq.distance_preservation(points(spark, sf_dir), book(spark, sf_dir)), "correlation", "mape")


#: Points with their whole code and the target.
CODED_F = "cf AS (SELECT coded.id, pq_code AS c, sqrt(list_dot_product(list_slice(v, 1, 8), list_slice(v, 1, 8))) AS f FROM coded JOIN e USING (id))"


def whole_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, c, f), written: rows join their codes' counts from plain scans, so a code of any size is split."""
    return keep(coded(spark, sf_dir, book(spark, sf_dir)).select("id", _text().alias("c"), vectors.norm(vectors.sub_vector(F.col("v"), 0, 8)).alias("f")), "codes")


@query(
    with_(BOOK_SQL, CODED, CODED_F, "o AS (SELECT id, CAST(row_number() OVER (PARTITION BY c ORDER BY md5('42|' || id), id) > greatest(1, 100 // (SELECT count(DISTINCT c) FROM cf)) AS INTEGER) AS late FROM cf)")
    + "SELECT id FROM o ORDER BY late, md5('42|' || id), id LIMIT 100"
)
def pq_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_top_up(whole_code(spark, sf_dir), "c", 100).select("id")


@query(with_(BOOK_SQL, CODED, CODED_F) + f"SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY c) AS w FROM cf) ORDER BY {U.format(42, 'id')} / w, id LIMIT 100")
def pq_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_code(spark, sf_dir)
    sized = rows.join(keep(rows.groupBy("c").agg(F.count("*").cast("double").alias("w")), "sizes"), "c")
    return sampling.weighted_sample(sized, F.col("w"), 100).select("id")


@query(with_(BOOK_SQL, CODED, CODED_F) + f"SELECT id FROM (SELECT id, coalesce(var_samp(f) OVER (PARTITION BY c), 1.0) AS w FROM cf) ORDER BY CASE WHEN w > 0 THEN {U.format(42, 'id')} / w END NULLS LAST, id LIMIT 100")
def pq_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_code(spark, sf_dir)
    weighted = rows.join(keep(rows.groupBy("c").agg(F.coalesce(F.var_samp("f"), F.lit(1.0)).alias("w")), "variances"), "c")
    return sampling.weighted_sample(weighted, F.col("w"), 100).select("id")


# Residual variance x target variance x size, density, target variance: importances of codes, and odds of points.
CODE_STATS = "st AS (SELECT m, code, count(*) AS size, avg(dist) AS spread, coalesce(var_samp(dist), 0) AS vr, coalesce(var_samp(sqrt(list_dot_product(list_slice(v, 1, 8), list_slice(v, 1, 8)))), 0) AS vf FROM pl JOIN e USING (id) GROUP BY 1, 2)"
CODE_IMPORTANCE = {
    "residual_variance": "least(greatest(sqrt(greatest(vr, 1e-6) * greatest(vf, 1e-6)) * size, 1e-6), 10.0 * size)",
    "cluster_density": "size / (1 + spread)",
    "target_variance": "least(greatest(vf * size, 1e-6), 10.0 * size)",
    "proportional": "CAST(size AS DOUBLE)",
}


def target() -> Column:
    return vectors.norm(vectors.sub_vector(F.col("v"), 0, 8))


def odds_sql(strategy: str) -> str:
    return with_(
        BOOK_SQL, CODE_STATS, f"im AS (SELECT m, code, size, ln(1 + greatest({CODE_IMPORTANCE[strategy]}, 1e-6)) AS l FROM st)",
        "sx AS (SELECT m, code, size, exp(l / max(l) OVER (PARTITION BY m) - 1) AS ex FROM im)", "sp AS (SELECT m, code, ex / sum(ex) OVER (PARTITION BY m) / size AS each FROM sx)",
        "raw AS (SELECT id, avg(each) AS r FROM pl JOIN sp ON pl.m = sp.m AND pl.code = sp.code GROUP BY 1)",
    )


def _odds(strategy: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        odds = importance_ops.odds(points(spark, sf_dir), book(spark, sf_dir), target(), strategy)
        return odds.select("id", F.round(F.col("q") * 1000, 6).alias("q_per_mille"))

    run.__name__ = f"pq_odds_{strategy}"
    query(odds_sql(strategy) + "SELECT id, round(1000 * r / sum(r) OVER (), 6) AS q_per_mille FROM raw")(run)


for _strategy in CODE_IMPORTANCE:
    _odds(_strategy)


def _placed(total: int, odds: str) -> str:
    """SQL: draws 0, 1, ... and the points whose part of the running sum of odds, in blocks of ids by hash, they fall into."""
    return (
        f"od AS ({odds}), bl AS (SELECT *, floor({U.format('block', 'id')} * 256) AS block FROM od), hi AS (SELECT id, q, sum(q) OVER (ORDER BY block, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM bl), "
        f"dw AS (SELECT r AS draw, {U.format(42, 'r')} AS u FROM range({total}) AS t(r))"
    )


@query(
    odds_sql("residual_variance").rstrip()
    + ", "
    + _placed(100, "SELECT id, r / sum(r) OVER () AS q FROM raw")
    + " SELECT draw, id, round(1 / ((SELECT count(*) FROM od) * q), 6) AS weight FROM dw JOIN hi ON u >= hi - q AND u < hi"
)
def pq_sample_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    odds = importance_ops.odds(points(spark, sf_dir), book(spark, sf_dir), target(), "residual_variance")
    return rounded(sampling.with_replacement(keep(odds, "odds"), 100), "weight")


V1 = {
    "proportional": "CAST(size AS DOUBLE)",
    "residual_variance": "CASE WHEN size < 2 THEN size ELSE vr * vf * size END",
    "cluster_density": "size / (1 + spread)",
}


def _first_subspace(strategy: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = importance_ops.first_subspace_sample(points(spark, sf_dir), book(spark, sf_dir), target(), 100, strategy, temperature=20.0)
        return rounded(found, "weight")

    run.__name__ = f"pq_first_subspace_{strategy}"
    query(
        with_(
            BOOK_SQL, "k AS (SELECT pl.id, CAST(code AS INTEGER) AS bucket, dist, v, sqrt(list_dot_product(list_slice(v, 1, 8), list_slice(v, 1, 8))) AS f FROM pl JOIN e USING (id) WHERE m = 0)",
            f"mu AS (SELECT bucket, list(a ORDER BY i) AS mid FROM (SELECT bucket, i, avg(v[i]) AS a FROM k, range(1, {DIM + 1}) AS t(i) GROUP BY 1, 2) GROUP BY 1)",
            "st AS (SELECT bucket, count(*) AS size, var_samp(dist) AS vr, var_samp(f) AS vf, avg(list_distance(v, mid)) AS spread FROM k JOIN mu USING (bucket) GROUP BY 1)",
            f"im AS (SELECT *, {V1[strategy]} AS imp FROM st)", "sx AS (SELECT *, exp((imp - max(imp) OVER ()) / 20.0) AS ex FROM im)", "sp AS (SELECT *, ex / sum(ex) OVER () AS p, sum(size) OVER () AS total FROM sx)",
            "qq AS (SELECT *, least(floor(p * 100), size) AS quota FROM sp)",
            "qt AS (SELECT bucket, size, p, total, greatest(0, least(quota, 100 - coalesce(sum(quota) OVER (ORDER BY p DESC, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS n FROM qq WHERE quota > 0)", DRAWN,
        )
        + "SELECT id, bucket AS code, round(1 / (p * n / size * total), 6) AS weight FROM r WHERE rk <= n"
    )(run)


for _strategy in V1:
    _first_subspace(_strategy)


@query(
    with_(BOOK_SQL, f"dr AS (SELECT r AS id, CAST(m AS INTEGER) AS m, CAST(floor(CAST(CAST('0x' || substr(md5('42-' || m || '|' || r), 1, 8) AS BIGINT) / 4294967296 AS DOUBLE) * {CODES}) AS INTEGER) AS code FROM range(1000) AS a(r), range({SUBSPACES}) AS b(m))")
    + "SELECT dr.id, string_agg(CAST(dr.code AS VARCHAR), ',' ORDER BY dr.m) AS pq_code, round(sum(list_sum(pc.x)), 6) AS total FROM dr JOIN pc ON dr.m = pc.m AND dr.code = pc.code GROUP BY 1"
)
def pq_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pq.synthetic(spark, book(spark, sf_dir), 1000, noise=0.0)
    return made.select("id", _text().alias("pq_code"), F.round(vectors.total(F.col("v")), 6).alias("total"))


@query()
def pq_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstruction errors with and without the rotation to directions of largest variance."""
    p = points(spark, sf_dir)
    turned = pq.train(p, DIM, SUBSPACES, CODES, STEPS, SEED, rotation=pq.rotation(p, DIM))
    return pq.reconstruction_error(p, turned).withColumnRenamed("mse_row", "rotated").crossJoin(pq.reconstruction_error(p, book(spark, sf_dir)).select(F.col("mse_row").alias("plain"))).select("rotated", "plain")  # one row each


@query(
    with_(
        BOOK_SQL, lloyd_sql(1, 8, STEPS, "z"), "pb AS (SELECT q_id, zc.code AS cell FROM q, zc QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY list_distance(qv, zc.x), zc.code) <= 3)",
        f"d AS (SELECT q.q_id, pl.id, sqrt(sum(pow({_PART}, 2))) AS dist FROM q JOIN pb USING (q_id) JOIN zl ON zl.code = pb.cell JOIN pl ON pl.id = zl.id JOIN pc ON pl.m = pc.m AND pl.code = pc.code WHERE q.q_id <> pl.id GROUP BY 1, 2)",
    )
    + "SELECT q_id, rn, dist FROM ("
    + top("d")
    + ")"
)
def pq_coarse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in each query's nearest cells only."""
    p, b = points(spark, sf_dir), book(spark, sf_dir)
    centres, cells = pq.coarse_cells(p, 8, STEPS)
    found = pq.cell_search(p, coded(spark, sf_dir, b).drop("v").join(cells, "id"), asked(spark, sf_dir), b, centres, n_probe=3)
    return rounded(found, "dist").select("q_id", "rn", "dist")


@query(
    with_(
        lloyd_sql(1, 8, STEPS, "z"), "pb AS (SELECT q_id, qv, zc.code AS cell FROM q, zc QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY list_distance(qv, zc.x), zc.code) <= 7)",
        "d AS (SELECT q_id, zl.id, list_distance(qv, zl.x) AS dist FROM pb JOIN zl ON zl.code = pb.cell WHERE q_id <> zl.id)",
    )
    + top("d")
)
def coarse_cells_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in each query's nearest cells by the vectors themselves."""
    p = points(spark, sf_dir)
    centres, cells = pq.coarse_cells(p, 8, STEPS)
    return rounded(pq.cell_search_exact(p.join(cells, "id"), asked(spark, sf_dir), centres, n_probe=7), "dist")


@query()
def pq_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the book without centroids close to more important ones."""
    b = book(spark, sf_dir)
    codes = coded(spark, sf_dir, b)
    weights = {(r.subspace, r.code): r.importance for r in pq.code_importance(codes, b).collect()}  # a row a code
    small, goes = pq.compressed(b, weights, threshold=0.3, least=2)
    return codes.select("id", _text().alias("pq_code"), F.concat_ws(",", F.transform(pq.mapped(F.col("pq_code"), goes), lambda c: c.cast("string"))).alias("small_code"), F.lit(small.ratio(1000)).alias("ratio"))


@query()
def pq_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, b = points(spark, sf_dir), book(spark, sf_dir)
    return pq.reconstruction_error(p, pq.calibrate(p, b, epochs=2, rate=0.5)).crossJoin(pq.reconstruction_error(p, b).select(F.col("mse_row").alias("before")))  # one row each


@query()
def diffusion_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    found = pq.DiffusionMap.fit(p, components=3, landmarks=200)
    mapped = p.select("id", "v", found.extend()("v").alias("m"))
    return mapped.select("id", "m", vectors.l2(F.col("v"), found.pre_image()("m")).alias("pre_image_error"))


@query(
    with_(
        BOOK_SQL, DECODED, "t AS (SELECT q_id, id, list_distance(qv, v) AS dist FROM q, e WHERE q_id <> id)", "u AS (SELECT q_id, id, list_distance(qv, r) AS dist FROM q, dec WHERE q_id <> id)",
        f"a AS ({top('t', 5)}), b AS ({top('u', 5)}), x AS (SELECT a.q_id, count(b.id) / 5.0 AS r FROM a LEFT JOIN b ON a.q_id = b.q_id AND a.id = b.id GROUP BY 1)",
    )
    + f"SELECT (SELECT round(avg(r), 6) FROM x) AS recall, round(avg(d2), 6) AS mse_row, round(avg(d2) / {DIM}, 6) AS mse_element FROM (SELECT pow(list_distance(v, r), 2) AS d2 FROM e JOIN dec USING (id))"
)
def quantizer_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tuning.evaluate(points(spark, sf_dir), asked(spark, sf_dir), book(spark, sf_dir)), "recall", "mse_row", "mse_element")


@query(
    with_(BOOK_SQL, DECODED, "d AS (SELECT list_distance(v, r) AS d FROM e JOIN dec USING (id))", "w AS (SELECT min(d) AS a, (max(d) - min(d)) / 20 AS w FROM d)", "x AS (SELECT CAST(least(floor((d - a) / w), 19) AS INTEGER) AS bin, a, w FROM d, w)")
    + "SELECT bin, round(min(a + bin * w), 6) AS low, round(min(a + (bin + 1) * w), 6) AS high, count(*) AS n FROM x GROUP BY 1"
)
def reconstruction_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tuning.error_histogram(points(spark, sf_dir), book(spark, sf_dir)), "low", "high")


# -- clustering -----------------------------------------------------------------------------------------------------

KM = lloyd_sql(1, CLUSTERS, 3, "k")


def clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray]:
    p = labelled(spark, sf_dir).withColumnRenamed("label", "truth")
    centres = np.array(kmeans.lloyd(p, CLUSTERS, 3, SEED))
    return kmeans.assigned(p, centres), centres


@query(with_(KM) + "SELECT id, CAST(code AS INTEGER) AS label, round(dist, 6) AS dist FROM kl")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clustered(spark, sf_dir)[0].select("id", "label", "dist"), "dist")


@query(with_(KM) + "SELECT CAST(kc.code AS INTEGER) AS label, count(kl.id) AS size FROM kc LEFT JOIN kl ON kc.code = kl.code GROUP BY 1")
def kmeans_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cluster_sizes(clustered(spark, sf_dir)[0], CLUSTERS)


@query(
    with_(KM)
    + "SELECT round(sum(dist), 6) AS inertia, round(sum(dist * dist), 6) AS inertia_squared, round(avg(dist), 6) AS mean_distance, count(DISTINCT code) AS n_clusters, (SELECT round(CAST(min(n) AS DOUBLE) / max(n), 6) FROM (SELECT count(*) AS n FROM kl GROUP BY code)) AS balance FROM kl"
)
def kmeans_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.bundle(clustered(spark, sf_dir)[0], CLUSTERS), "inertia", "inertia_squared", "mean_distance", "balance")


@query(
    with_(KM, "g AS (SELECT code, sum(dist) AS s, count(*) AS n FROM kl GROUP BY 1)", "t AS (SELECT sum(s) / sum(n) AS st, avg(s / n) AS cv, sum(n) AS total FROM g)", "h AS (SELECT sum(-(n / CAST(total AS DOUBLE)) * ln(n / CAST(total AS DOUBLE) + 1e-8)) AS h FROM g, t)", "r AS (SELECT avg(exp(-list_distance(a.x, b.x))) AS r FROM kc a JOIN kc b ON a.code <> b.code)")
    + "SELECT round(st, 6) AS standard, round(cv, 6) AS cluster_variance, round(st - 0.1 * h, 6) AS entropy, round(st + 0.1 * r, 6) AS repulsion FROM t, h, r"
)
def kmeans_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = clustered(spark, sf_dir)
    return rounded(gradient.losses(rows.drop("label", "dist"), centres), "standard", "cluster_variance", "entropy", "repulsion")


@query()
def gradient_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return gradient.GradientKMeans(CLUSTERS, steps=5).fit(p).predict(p).select("id", "label")


@query()
def compressed_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means on all numbers against its first principal components."""
    return projection.compare_training(points(spark, sf_dir), DIM, CLUSTERS, count=8, steps=3)


@query()
def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(metrics.k_sweep(points(spark, sf_dir), [2, 4], steps=2))


PARTS = "pt AS (SELECT p_partkey AS id, [p_brand, p_type, CAST(p_size AS VARCHAR)] AS v FROM part)"


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("v"))


@query(
    "WITH "
    + ",\n".join([
        PARTS, "ds AS (SELECT v, min(id) AS id FROM pt GROUP BY v)", "c AS (SELECT v AS cv, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS label FROM ds QUALIFY label < 4)",
        "a AS (SELECT id, v, label FROM pt, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY CAST(v[1] <> cv[1] AS INTEGER) + CAST(v[2] <> cv[2] AS INTEGER) + CAST(v[3] <> cv[3] AS INTEGER), label) = 1)",
        "n AS (SELECT label, i, v[i] AS x, count(*) AS n FROM a, range(1, 4) AS t(i) GROUP BY 1, 2, 3)",
    ])
    + "\nSELECT CAST(label AS INTEGER) AS label, CAST(i - 1 AS INTEGER) AS pos, x AS mode FROM n QUALIFY row_number() OVER (PARTITION BY label, i ORDER BY n DESC, x) = 1"
)
def kmodes_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = categories(spark, sf_dir)
    model = kmeans.KModes(4, steps=1).fit(rows)
    return spark.createDataFrame([(k, i, x) for k, m in enumerate(model.modes) for i, x in enumerate(m)], "label int, pos int, mode string")


@query()
def kmodes_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = categories(spark, sf_dir)
    return kmeans.KModes(4, steps=5).fit(rows).predict(rows).select("id", "label")


EPS, MIN_SAMPLES = 1.1, 3
EDGES = f"ed AS (SELECT x.id AS a, y.id AS b, list_distance(x.v, y.v) AS dist FROM e x JOIN e y ON x.id < y.id WHERE list_distance(x.v, y.v) <= {EPS})"
CORE = f"bo AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), cr AS (SELECT id FROM e LEFT JOIN bo ON bo.a = id GROUP BY id HAVING count(bo.b) + 1 >= {MIN_SAMPLES})"
LABELS = (
    "cc AS (SELECT bo.a, bo.b FROM bo JOIN cr x ON x.id = bo.a JOIN cr y ON y.id = bo.b), reach(id, r) AS (SELECT id, id FROM cr UNION SELECT cc.b, reach.r FROM reach JOIN cc ON cc.a = reach.id), "
    "rt AS (SELECT id, min(r) AS root FROM reach GROUP BY 1), nb AS (SELECT id, dense_rank() OVER (ORDER BY root) AS cluster FROM rt), "
    "bd AS (SELECT bo.a AS id, min(cluster) AS cluster FROM bo JOIN nb ON nb.id = bo.b GROUP BY 1)"
)


@query(with_(EDGES) + "SELECT a, b, round(dist, 6) AS dist FROM ed")
def radius_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ann.radius_neighbours(points(spark, sf_dir), EPS), "dist")


@query(with_(EDGES, CORE) + "SELECT id FROM cr")
def dbscan_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return dbscan.core_points(p, ann.radius_neighbours(p, EPS).select("a", "b"), MIN_SAMPLES)


@query(with_(EDGES, CORE, LABELS) + "SELECT e.id, CAST(coalesce(nb.cluster, bd.cluster, 0) AS INTEGER) AS cluster FROM e LEFT JOIN nb ON nb.id = e.id LEFT JOIN bd ON bd.id = e.id")
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.dbscan(points(spark, sf_dir), EPS, MIN_SAMPLES)


@query(
    with_(
        EDGES, CORE, LABELS, "lb AS (SELECT e.id, v, coalesce(nb.cluster, bd.cluster) AS cluster FROM e LEFT JOIN nb ON nb.id = e.id LEFT JOIN bd ON bd.id = e.id)",
        f"ce AS (SELECT cluster, list(a ORDER BY i) AS c FROM (SELECT cluster, i, avg(v[i]) AS a FROM lb, range(1, {DIM + 1}) AS t(i) WHERE cluster IS NOT NULL GROUP BY 1, 2) GROUP BY 1)",
        "ne AS (SELECT id, cluster, list_distance(v, c) AS d FROM e, ce QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(v, c), cluster) = 1)",
    )
    + f"SELECT e.id, CAST(CASE WHEN d <= {EPS} THEN cluster ELSE 0 END AS INTEGER) AS cluster FROM e LEFT JOIN ne USING (id)"
)
def dbscan_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    model = dbscan.DBSCAN(EPS, MIN_SAMPLES)
    model.fit(p)
    return model.predict(p)


CONTINGENCY = "ct AS (SELECT label AS t, code AS p, count(*) AS n FROM kl JOIN e USING (id) GROUP BY 1, 2), tt AS (SELECT t, sum(n) AS nt FROM ct GROUP BY 1), pp AS (SELECT p, sum(n) AS np FROM ct GROUP BY 1), al AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM ct)"


@query(
    with_(KM, CONTINGENCY, "s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM ct) AS c, (SELECT sum(nt * (nt - 1) / 2.0) FROM tt) AS a, (SELECT sum(np * (np - 1) / 2.0) FROM pp) AS b, (SELECT total * (total - 1) / 2 FROM al) AS z)")
    + "SELECT round((c - a * b / z) / ((a + b) / 2 - a * b / z), 6) AS ari FROM s"
)
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.adjusted_rand(clustered(spark, sf_dir)[0], "truth", "label"), "ari")


@query(
    with_(KM, CONTINGENCY, "s AS (SELECT (SELECT sum(n / total * ln(n * total / (nt * np))) FROM ct JOIN tt USING (t) JOIN pp USING (p), al) AS mi, (SELECT sum(-nt / total * ln(nt / total)) FROM tt, al) AS ht, (SELECT sum(-np / total * ln(np / total)) FROM pp, al) AS hp)")
    + "SELECT round(mi, 6) AS mutual, round(ht, 6) AS h_truth, round(hp, 6) AS h_found, round(mi / ht, 6) AS homogeneity, round(mi / ((ht + hp) / 2), 6) AS nmi FROM s"
)
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.information(clustered(spark, sf_dir)[0], "truth", "label")
    return rounded(found, "mutual", "h_truth", "h_found", "homogeneity", "nmi")


@query(
    with_(
        KM, "pd AS (SELECT x.id, x.code AS l1, y.code AS l2, avg(list_distance(x.x, y.x)) AS d FROM kl x JOIN kl y ON x.id <> y.id GROUP BY 1, 2, 3)",
        "ab AS (SELECT id, max(CASE WHEN l1 = l2 THEN d END) AS a, min(CASE WHEN l1 <> l2 THEN d END) AS b FROM pd GROUP BY 1)",
    )
    + "SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab"
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.silhouette(clustered(spark, sf_dir)[0].select("id", "label", "v")), "silhouette")


# -- tuning and catalog ---------------------------------------------------------------------------------------------

PAIRS = "pr AS (SELECT list_distance(x.v, y.v) AS d FROM e x JOIN e y ON x.id < y.id)"


@query(with_(PAIRS) + "SELECT round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.25), 6) AS p25, round(avg(d), 6) AS mean FROM pr")
def pairwise_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tuning.distance_percentiles(points(spark, sf_dir), [0.1, 0.25]), "p10", "p25", "mean")


def collision_sql(distance: str, width: str, steps: int = 200) -> str:
    t = f"({width} / {steps} * i)"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    value = f"exp(-{t} * {t} / (2 * {distance} * {distance})) / ({distance} * sqrt(2 * pi())) * (1 - {t} / {width})"
    return f"list_sum(list_transform(range({steps + 1}), lambda i: {weight} * {value})) * {width} / {steps} / 3"


@query("SELECT CAST(w AS DOUBLE) AS w, CAST(s AS DOUBLE) AS s, round(" + collision_sql("CAST(s AS DOUBLE)", "CAST(w AS DOUBLE)") + ", 6) AS p FROM (VALUES (0.5), (1.0), (2.0), (4.0)) AS a(w), (VALUES (0.7), (1.4)) AS b(s)")
def collision_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(w, s) for w in (0.5, 1.0, 2.0, 4.0) for s in (0.7, 1.4)], "w double, s double")
    return grid.select("w", "s", F.round(collision_column(F.col("s"), F.col("w")), 6).alias("p"))


@query(
    with_(PAIRS, "r AS (SELECT quantile_cont(d, 0.1) AS r FROM pr)", "g AS (SELECT r, 0.1 * r + i * (9.9 * r / 49) AS w FROM r, range(50) AS t(i))", f"c AS (SELECT w, {collision_sql('r', 'w')} AS p1, {collision_sql('(2 * r)', 'w')} AS p2 FROM g)")
    + "SELECT round(w, 6) AS w, round(p1, 6) AS p1, round(p2, 6) AS p2, round(ln(1 / p1) / ln(1 / p2), 6) AS rho FROM c"
)
def rho_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = tuning.distance_percentiles(points(spark, sf_dir), [0.1]).select("p10")
    return rounded(tuning.rho_table(near), "w", "p1", "p2", "rho")


@query(with_(f"s AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) AS s FROM e, range(1, {DIM + 1}) AS t(i) GROUP BY 1)") + "SELECT id, CAST(i - 1 AS INTEGER) AS pos, round((v[i] - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM e, s")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    scale = kmeans.Scale.fit(p)
    return rounded(p.select("id", F.posexplode(scale.apply(F.col("v"))).alias("pos", "z")), "z")


#: The engine's hash families are drawn from the dataset's parameters, so SQL can state them.
STORED = {"w": 0.5, "k": 2, "L": 4, "sampling_ratio": 1.0, "initial_radius": 1.5, "radius_expansion": 2.0}
STORED_FAMILY = HashFamily.draw(DIM, STORED["L"], STORED["k"], STORED["w"])
#: Points that count after the second batch was replaced by its even half.
LIVE = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 3 <> 1 OR vec_id % 2 = 0), q AS (SELECT id AS q_id, v AS qv FROM e WHERE id % 20 = 0)"


def engine_of(spark: SparkSession, sf_dir: str) -> catalog.Engine:
    """An engine in a folder of its own: dataset vectors, in three batches of which the second was ingested twice, with
    other rows; dataset plain, empty."""
    engine, p = catalog.Engine(spark, new_path(spark, "engine")), points(spark, sf_dir)
    engine.create_dataset("plain", 8, distance_metric="cosine")
    engine.create_dataset("vectors", DIM, **STORED)
    for name, rows in (("b0", p.where("id % 3 = 0")), ("b1", p.where("id % 3 = 1")), ("b2", p.where("id % 3 = 2")), ("b1", p.where("id % 3 = 1 AND id % 2 = 0"))):
        engine.ingest("vectors", rows, name)
    return engine


@query("SELECT * FROM (VALUES ('vectors', 64, 100, 2, 4, 0.5::DOUBLE, 'euclidean', 1.5::DOUBLE), ('plain', 8, 100, 10, 5, 1.0::DOUBLE, 'cosine', NULL)) AS t(name, dimension, m, k, L, w, distance_metric, initial_radius)")
def dataset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_of(spark, sf_dir).list_datasets().select("name", "dimension", "m", "k", "L", "w", "distance_metric", "initial_radius")


@query("SELECT 'vectors' AS dataset, 'b' || (vec_id % 3) AS batch_id, count(*) AS size FROM embeddings WHERE vec_id % 3 <> 1 OR vec_id % 2 = 0 GROUP BY 2")
def batch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_of(spark, sf_dir).batches().select("dataset", "batch_id", "size")


@query("SELECT 'vectors' AS dataset, 'b1' AS batch_id, count(*) AS size, 64 AS dimension, 'euclidean' AS distance_metric FROM embeddings WHERE vec_id % 6 = 4")
def batch_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine_of(spark, sf_dir).batch_info("vectors", "b1")
    return spark.createDataFrame([tuple(found[c] for c in ("dataset", "batch_id", "size", "dimension", "distance_metric"))], "dataset string, batch_id string, size long, dimension int, distance_metric string")


@query("WITH " + LIVE + " SELECT count(*) AS total_points, 3 AS processed_batches, (SELECT 100 - count(*) FROM range(0)) AS m FROM e")
def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a dataset restored from a saved one."""
    engine = engine_of(spark, sf_dir)
    saved = new_path(spark, "saved")
    engine.save("vectors", saved)
    engine.load(saved, "copy")
    found = engine.stats("copy")
    return spark.createDataFrame([(found["total_points"], found["processed_batches"], engine.dataset("copy")["m"])], "total_points long, processed_batches int, m long")


@query("WITH " + LIVE + ",\n" + index_sql(STORED_FAMILY) + " SELECT table_id, bucket_key AS hash_value, count(*) AS n FROM idx GROUP BY 1, 2")
def engine_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of the stored index, which grew by batches and lost the replaced one."""
    return engine_of(spark, sf_dir).buckets("vectors")


_RADII = [1.0, *[STORED["initial_radius"] * STORED["radius_expansion"] ** i for i in range(1, 5)]]
ADAPTED = [
    *[index_sql(STORED_FAMILY, r, f"i{i}") for i, r in enumerate(_RADII)],
    "lv AS (" + " UNION ALL ".join(f"SELECT DISTINCT a.id AS q_id, b.id, {i} AS level FROM i{i} a JOIN i{i} b USING (table_id, bucket_key) WHERE a.id % 20 = 0 AND a.id <> b.id" for i in range(5)) + ")",
    "n AS (SELECT q_id, level, count(*) AS n FROM lv GROUP BY 1, 2)", f"c AS (SELECT q_id, coalesce(min(CASE WHEN n >= {3 * K} THEN level END), max(level)) AS level FROM n GROUP BY 1)",
    "cand AS (SELECT lv.q_id, lv.id FROM lv JOIN c USING (q_id, level))",
]


@query("WITH " + ",\n".join([LIVE, *ADAPTED, RANKED]) + "\n" + top("d"))
def engine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by the engine: stored index, buckets widened from the tuned radius on, exact distances."""
    found = engine_of(spark, sf_dir).query("vectors", asked(spark, sf_dir).where("q_id % 3 <> 1 OR q_id % 2 = 0"), K, exclude_self=True)
    return rounded(found, "dist")


@query(
    "WITH " + LIVE + ",\n" + index_sql(STORED_FAMILY) + ", k AS (SELECT id, bucket_key AS bucket FROM idx WHERE table_id = 0), "
    + "s AS (SELECT bucket, count(*) AS size, 100 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM k GROUP BY 1), "
    + "o AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, bucket) AS place, 100 - sum(floor(share)) OVER () AS left_over FROM s), "
    + "qt AS (SELECT bucket, size, p, least(floor(share) + CAST(place <= left_over AS INTEGER), size) AS n FROM o), " + DRAWN + " " + STRATIFIED
)
def engine_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(engine_of(spark, sf_dir).sample("vectors", size=100), "weight", "weight_ht")


@query(with_(index_sql(FAMILY), index_sql(FAMILY, 0.5, "fine")) + "SELECT DISTINCT table_id, bucket_key AS hash_value FROM fine WHERE (table_id, bucket_key) NOT IN (SELECT (table_id, bucket_key) FROM idx)")
def stale_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    stored = ann.bucket_sizes(ann.build_index(p, FAMILY, radius=0.5)).select("table_id", F.col("bucket_key").alias("hash_value"))
    return catalog.stale_buckets(stored, ann.build_index(p, FAMILY))


@query(f"SELECT label, count(*) AS n, round(avg(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS mean_norm, round(sum(CAST(embedding[{DIM}] AS DOUBLE)), 6) AS last FROM embeddings GROUP BY 1")
def wide_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as a column for each number and read back."""
    path = new_path(spark, "wide")
    write_wide(labelled(spark, sf_dir), path, DIM, label="label")
    rows = read_wide(spark, path)
    return rounded(rows.groupBy("label").agg(F.count("*").alias("n"), F.avg(vectors.norm(F.col("v"))).alias("mean_norm"), F.sum(F.col("v")[DIM - 1]).alias("last")), "mean_norm", "last")
