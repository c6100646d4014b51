"""Stratified, density-weighted and importance sampling, with the weights that estimators need.

Draws are fixed by a seed: rows are ordered by a hash of seed and id, never by a random number of the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key, uniform
from ..sources.scratch import keep


def _down(*order: Column | str) -> Window:
    return Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


#: Parts in which a stratum is ranked first, so that a large one isn't sorted in one task.
SALTS = 64


def first_of(rows: DataFrame, most: Column, keys: list[str], seed: int, id_: str = "id") -> DataFrame:
    """The first `most` rows of each stratum by hash order, with rank: ranked in salted parts, then among what is left."""
    order = [order_key(seed, F.col(id_)), F.col(id_)]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(id_), F.lit(SALTS)))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order))).where(F.col("rank") <= most).drop("salt", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def drawn(rows: DataFrame, quotas: DataFrame, keys: list[str], seed: int, id_: str = "id") -> DataFrame:
    """Of each stratum its quota of rows n, without replacement. Only strata with a quota are ranked."""
    return first_of(rows.join(keep(quotas.where("n > 0"), "quotas"), keys), F.col("n"), keys, seed, id_).drop("rank")


def proportional_quotas(sizes: DataFrame, key: str, total: int) -> DataFrame:
    """(key, size, n, p): floor of the share and largest remainders, ties by key; n is at most the size. There may be as
    many strata as rows, so only those that get one more, fewer than total, are ordered."""
    sizes = keep(sizes, "sizes")
    rows = sizes.agg(F.sum("size")).first()[0] or 1
    share = F.lit(total) * F.col("size") / F.lit(rows)
    out = sizes.withColumn("floor", F.floor(share)).withColumn("rest", share - F.floor(share))
    left = total - (out.agg(F.sum("floor")).first()[0] or 0)
    more = out.orderBy(F.desc("rest"), key).limit(max(int(left), 0)).select(key, F.lit(1).alias("more"))
    n = F.least(F.col("floor") + F.coalesce("more", F.lit(0)), F.col("size"))
    return out.join(more, key, "left").select(key, "size", n.alias("n"), (F.col("size") / F.lit(rows)).alias("p"))


def balanced_quotas(sizes: DataFrame, key: str, total: int) -> DataFrame:
    """(key, size, n, p): equal quotas capped by the sizes, one pass of one more in order of key for what is left."""
    sizes = keep(sizes, "sizes")
    count = sizes.count() or 1
    out = sizes.withColumn("base", F.least(F.lit(total // count), F.col("size")))
    left = total - (out.agg(F.sum("base")).first()[0] or 0)
    more = out.where("base < size").orderBy(key).limit(max(int(left), 0)).select(key, F.lit(1).alias("more"))
    return out.join(more, key, "left").select(key, "size", (F.col("base") + F.coalesce("more", F.lit(0))).alias("n"), F.lit(1 / count).alias("p"))


def stratified(rows: DataFrame, key: str, total: int, strategy: str = "proportional", seed: int = 42, id_: str = "id") -> DataFrame:
    """(id, weight, weight_ht): weight is 1 / (p n / size), weight_ht size / n, the unbiased one for totals."""
    quotas = {"proportional": proportional_quotas, "balanced": balanced_quotas}.get(strategy)
    if quotas is None:
        raise ValueError(f"unknown strategy {strategy!r}")
    sizes = rows.groupBy(key).agg(F.count("*").alias("size"))
    found = drawn(rows.select(key, id_), quotas(sizes, key, total), [key], seed, id_)
    return found.select(id_, (1 / (F.col("p") * F.col("n") / F.col("size"))).alias("weight"), (F.col("size") / F.col("n")).alias("weight_ht"))


def uniform_sample(rows: DataFrame, total: int, seed: int = 42, id_: str = "id") -> DataFrame:
    return rows.orderBy(order_key(seed, F.col(id_)), id_).limit(total)


def reservoir(rows: DataFrame, size: int = 1000, seed: int = 42, id_: str = "id") -> DataFrame:
    """A uniform sample that merges: that of a union is the sample of both samples' union."""
    return uniform_sample(rows, size, seed, id_)


def weighted_sample(rows: DataFrame, weight: Column, total: int, seed: int = 42, id_: str = "id", method: str = "ratio") -> DataFrame:
    """The first total rows by u / weight (ratio), or by u ** (1 / weight) downwards (es), u hash-uniform. Only es draws
    in proportion to the weights at every step. Rows of weight zero come last."""
    u = uniform(seed, F.col(id_))
    if method == "ratio":
        order = [F.when(weight > 0, u / F.when(weight > 0, weight)).asc_nulls_last()]
    elif method == "es":
        order = [F.when(weight > 0, F.pow(u, 1 / F.when(weight > 0, weight))).desc_nulls_last()]
    else:
        raise ValueError(f"unknown method {method!r}")
    return rows.orderBy(*order, id_).limit(total)


def density_sample(rows: DataFrame, key: str, weight: str, total: int, seed: int = 42, id_: str = "id") -> DataFrame:
    """Rows kept with the odds min(1, share of the bucket's weight x total / its size), by hash-uniform numbers."""
    buckets = rows.groupBy(key).agg(F.sum(weight).alias("w"), F.count("*").alias("c"))
    buckets = buckets.crossJoin(F.broadcast(buckets.agg(F.sum("w").alias("all"))))  # one number
    odds = keep(buckets.select(key, F.least(F.lit(1.0), F.col("w") / F.col("all") * total / F.col("c")).alias("fraction")), "odds")
    return rows.join(odds, key).where(uniform(seed, F.col(id_)) < F.col("fraction"))


def balanced_top_up(rows: DataFrame, key: str, total: int, seed: int = 42, id_: str = "id") -> DataFrame:
    """max(1, total / strata) rows of each stratum, then random others up to total, cut at total."""
    each = F.greatest(F.lit(1), F.expr(f"cast({total} as bigint) div strata"))
    strata = F.broadcast(rows.agg(F.countDistinct(key).alias("strata")))  # one number
    # No stratum gives more than total rows altogether.
    ranked = first_of(rows, F.lit(total), [key], seed, id_).crossJoin(strata).withColumn("late", (F.col("rank") > each).cast("int")).drop("strata", "rank")
    return ranked.orderBy("late", order_key(seed, F.col(id_)), id_).limit(total).drop("late")


def softmax(strata: DataFrame, value: str, temperature: float) -> DataFrame:
    """Add p: exp(value / T) over its sum, shifted by the largest."""
    most = F.broadcast(strata.agg(F.max(value).alias("most")))  # one number
    out = strata.crossJoin(most).withColumn("p", F.exp((F.col(value) - F.col("most")) / temperature)).drop("most")
    whole = F.broadcast(out.agg(F.sum("p").alias("whole")))  # one number
    return out.crossJoin(whole).withColumn("p", F.col("p") / F.col("whole")).drop("whole")


def greedy_quotas(strata: DataFrame, key: str, total: int, cap: int | None = None, rounding: str = "ceil") -> DataFrame:
    """The strata that get rows, with n: by falling p they take their rounded share, at most their size, cap and what is
    left. Each step only takes away, so what is left is total minus the capped shares before, as a running sum. Every
    share taken is at least one, so only the first total strata can get any, and no more are summed in order."""
    share = F.ceil(F.col("p") * total) if rounding == "ceil" else F.floor(F.col("p") * total)
    quota = F.least(share, F.col("size"), *([F.lit(cap)] if cap is not None else []))
    out = strata.withColumn("quota", quota).where("quota > 0").orderBy(F.desc("p"), key).limit(total)
    before = F.coalesce(F.sum("quota").over(_down(F.desc("p"), key)), F.lit(0))
    return out.withColumn("n", F.greatest(F.lit(0), F.least(F.col("quota"), total - before))).drop("quota")


def topped_up(strata: DataFrame, quotas: DataFrame, key: str, total: int) -> DataFrame:
    """The quotas, and strata without any for what they leave of total: by falling p they take up to their size. Each
    takes one at least, so only as many as rows are left are summed in order."""
    quotas = keep(quotas.where("n > 0"), "quotas")
    left = total - (quotas.agg(F.sum("n")).first()[0] or 0)
    if left <= 0:
        return quotas
    out = strata.join(quotas.select(key), key, "left_anti").orderBy(F.desc("p"), F.desc("size"), key).limit(int(left))
    before = F.coalesce(F.sum("size").over(_down(F.desc("p"), F.desc("size"), key)), F.lit(0))
    more = out.withColumn("n", F.greatest(F.lit(0), F.least(F.col("size"), F.lit(int(left)) - before)))
    return quotas.unionByName(more.select(quotas.columns))


def bucket_importance(rows: DataFrame, key: str, target: Column, strategy: str = "proportional", cap: int = 100) -> DataFrame:
    """(key, size, mean, variance, importance): the size, the size up to cap, or variance x size."""
    stats = rows.groupBy(key).agg(F.count("*").alias("size"), F.avg(target).alias("mean"), F.coalesce(F.var_samp(target), F.lit(0.0)).alias("variance"))
    value = {"proportional": F.col("size").cast("double"), "balanced": F.least("size", F.lit(cap)).cast("double"), "variance": F.col("variance") * F.col("size")}.get(strategy)
    if value is None:
        raise ValueError(f"unknown strategy {strategy!r}")
    return stats.withColumn("importance", value)


def importance_sample(rows: DataFrame, key: str, target: Column, total: int, strategy: str = "proportional", temperature: float = 1.0, cap: int | None = None, seed: int = 42, id_: str = "id", linear: bool = False) -> DataFrame:
    """(id, bucket, weight): quotas by the softmax of the importances (or their shares, with linear), capped by default
    at a tenth of the sample, and topped up from the strata without one; weights 1 / (importance share x n / size x N), 1 where a share is 0."""
    cap = cap if cap is not None else max(1, total // 10)
    strata = keep(bucket_importance(rows, key, target, strategy, cap), "strata")
    whole = F.broadcast(strata.agg(F.sum("importance").alias("whole"), F.sum("size").alias("all")))  # two numbers
    part = F.col("importance") / F.when(F.col("whole") > 0, F.col("whole"))
    strata = strata.crossJoin(whole).withColumn("part", F.coalesce(part, F.lit(0.0))).drop("whole")
    strata = strata.withColumn("p", F.col("part")) if linear else softmax(strata, "importance", temperature)
    strata = keep(strata, "odds")
    quotas = topped_up(strata, greedy_quotas(strata, key, total, cap), key, total)
    found = drawn(rows.select(key, id_), quotas.select(key, "size", "n", "part", "all"), [key], seed, id_)
    odds = F.col("part") * F.col("n") / F.col("size") * F.col("all")
    return found.select(id_, F.col(key).alias("bucket"), F.coalesce(1 / F.when(odds > 0, odds), F.lit(1.0)).alias("weight"))


def point_probabilities(codes: DataFrame, strata: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(id, q): codes (id, subspace, code), strata (subspace, code, size, importance). Importances are kept above 1e-6,
    log1p, over their largest, softmax by subspace; a point's odds are the mean over subspaces of p / size, normalized."""
    one = Window.partitionBy("subspace")
    logged = F.log1p(F.greatest(F.coalesce("importance", F.lit(1e-6)), F.lit(1e-6)))
    strata = strata.withColumn("x", logged).withColumn("x", F.col("x") / F.max("x").over(one) / temperature)
    strata = strata.withColumn("e", F.exp(F.col("x") - F.max("x").over(one))).withColumn("p", F.col("e") / F.sum("e").over(one))
    odds = codes.join(strata.select("subspace", "code", (F.col("p") / F.col("size")).alias("each")), ["subspace", "code"]).groupBy("id").agg(F.avg("each").alias("raw"))
    return odds.crossJoin(F.broadcast(odds.agg(F.sum("raw").alias("all")))).select("id", (F.col("raw") / F.col("all")).alias("q"))  # one number


def create_sampler(sample: DataFrame, total: int, weight: str = "weight", seed: int = 42, id_: str = "id") -> DataFrame:
    """(draw, id): what a training loop reads, drawn with replacement from a weighted sample in proportion to its weights."""
    whole = F.broadcast(sample.agg(F.sum(weight).alias("_all")))  # one number
    odds = sample.select(F.col(id_).alias("id"), weight).crossJoin(whole).select("id", (F.col(weight) / F.col("_all")).alias("q"))
    return with_replacement(keep(odds, "odds"), total, seed, all_once=False).select("draw", "id")


def with_replacement(odds: DataFrame, total: int, seed: int = 42, blocks: int = 256, all_once: bool = True) -> DataFrame:
    """(draw, id, weight): total draws by inverse distribution from (id, q), with weights (1 / N) / q. The running sum is
    taken in blocks of ids by hash, block sums first, so that no task sorts all ids. With all_once and total at least N
    every row is taken once, with weight 1, instead."""
    n = odds.count()
    if all_once and total >= n:
        return odds.select(F.monotonically_increasing_id().alias("draw"), "id", F.lit(1.0).alias("weight"))
    odds = odds.withColumn("block", F.floor(uniform("block", F.col("id")) * blocks))
    sums = odds.groupBy("block").agg(F.sum("q").alias("s"))
    starts = sums.select("block", F.coalesce(F.sum("s").over(_down("block")), F.lit(0.0)).alias("start"))
    inside = Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = odds.join(F.broadcast(starts), "block").withColumn("hi", F.col("start") + F.sum("q").over(inside)).withColumn("lo", F.col("hi") - F.col("q"))
    draws = odds.sparkSession.range(total).select(F.col("id").alias("draw"), uniform(seed, F.col("id")).alias("u"))
    # Cells of the unit interval turn the range join into an equi-join; an interval reaches over few cells.
    cells = max(1, min(n, 1 << 20))
    draws = draws.withColumn("cell", F.floor(F.col("u") * cells))
    placed = placed.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))))
    found = draws.join(placed, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return found.select("draw", "id", (1 / (F.lit(float(n)) * F.col("q"))).alias("weight"))
