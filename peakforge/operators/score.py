"""Peak matching and everything that follows from it.

The exact score visits a candidate's peaks from the heaviest down and lets each
query peak count once. Weights of a spectrum are distinct, so this is: the
query weight v that a candidate's bin meets (the heaviest of the query peaks
within the tolerance), the heaviest candidate peak of each v, and the sum of the
products. The band join is an equality join: the query side is expanded by the
tolerance, once a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.config import BINS, MAX_SCORE
from .joins import among, meet


def expanded(queries: DataFrame, tolerance: int, id_col: str = "query_id") -> DataFrame:
    """(query_id, bin, v): each bin near a query peak with the weight of the heaviest.

    Bin 0 never matches, and nothing above the last bin but one tolerance does: peaks that near the end reach up to there.
    """
    last = BINS + 1 - tolerance
    upto = F.when(F.col("bin") >= last, F.lit(last)).otherwise(F.col("bin") + tolerance)
    near = queries.select(id_col, F.explode(F.sequence(F.col("bin") - tolerance, upto)).alias("bin"), F.col("w").alias("v"))
    return near.where("bin > 0").groupBy(id_col, "bin").agg(F.max("v").alias("v"))


def hits(queries: DataFrame, candidates: DataFrame, tolerance: int) -> DataFrame:
    """(query_id, idx, v, cw) of peaks that meet. queries: (query_id, bin, w), candidates: (idx, bin, w)."""
    own = candidates.where("bin > 0").select("idx", "bin", F.col("w").alias("cw"))
    return meet(expanded(queries, tolerance), own, "bin", "idx").select("query_id", "idx", "v", "cw")


def exact_dp(queries: DataFrame, candidates: DataFrame, tolerance: int) -> DataFrame:
    """(query_id, idx, dp) of pairs that share a peak."""
    best = hits(queries, candidates, tolerance).groupBy("query_id", "idx", "v").agg(F.max("cw").alias("cw"))
    return best.groupBy("query_id", "idx").agg(F.sum(F.col("v") * F.col("cw")).cast("bigint").alias("dp"))


def background_dp(queries: DataFrame, candidates: DataFrame, tolerance: int) -> DataFrame:
    """(query_id, idx, dp) in which every meeting pair of peaks counts (the inverted-index score)."""
    return hits(queries, candidates, tolerance).groupBy("query_id", "idx").agg(F.sum(F.col("v") * F.col("cw")).cast("bigint").alias("dp"))


def both_dps(queries: DataFrame, candidates: DataFrame, tolerance: int) -> DataFrame:
    """(query_id, idx, dp, background): the exact and the background score from one join."""
    by = hits(queries, candidates, tolerance).groupBy("query_id", "idx", "v").agg(F.max("cw").alias("cw"), F.sum("cw").alias("all"))
    return by.groupBy("query_id", "idx").agg(F.sum(F.col("v") * F.col("cw")).cast("bigint").alias("dp"), F.sum(F.col("v") * F.col("all")).cast("bigint").alias("background"))


def distance(cosine: Column) -> Column:
    gap = 1 - F.least(cosine, F.lit(1.0))
    return F.when(gap < 1e-8, F.lit(0.0)).otherwise(F.sqrt(F.lit(2.0)) * F.sqrt(gap))


def cosine_of(distance: Column) -> Column:
    return 1 - distance * distance / 2


def integer_score(cosine: Column, rounding=F.floor) -> Column:
    """The cosine on the integer scale, clamped."""
    return F.least(F.lit(MAX_SCORE), rounding(MAX_SCORE * cosine)).cast("int")


def with_cosine(pairs: DataFrame, query_norms: DataFrame, candidate_norms: DataFrame) -> DataFrame:
    """pairs with cosine and dist. Norms: (query_id, qnorm2), (idx, cnorm2)."""
    joined = pairs.join(query_norms, "query_id").join(candidate_norms, "idx")
    cosine = F.col("dp") / F.sqrt(F.col("qnorm2").cast("double") * F.col("cnorm2"))
    return joined.withColumn("cosine", F.least(cosine, F.lit(1.0))).withColumn("dist", distance(F.col("cosine"))).drop("qnorm2", "cnorm2")


def with_background_score(pairs: DataFrame, query_norms: DataFrame, candidate_norms: DataFrame) -> DataFrame:
    """(query_id, idx, dp, score) of pairs, the score on the integer scale; norms as for with_cosine.

    The product is put on the scale before it is divided: a cosine rounded first can fall below the integer that it stands for.
    """
    joined = pairs.join(query_norms, "query_id").join(candidate_norms, "idx")
    scaled = F.floor(F.lit(MAX_SCORE) * F.col("dp") / F.sqrt(F.col("qnorm2").cast("double") * F.col("cnorm2")))
    return joined.select("query_id", "idx", "dp", F.least(F.lit(MAX_SCORE).cast("bigint"), scaled).cast("int").alias("score"))


def enough_peaks(candidates: DataFrame, norms: DataFrame, min_peaks: int) -> DataFrame:
    """Candidates with more than min_peaks peaks."""
    return candidates.join(norms.where(F.col("n_peaks") > min_peaks).select(F.col("spec_id").alias("idx")), "idx", "left_semi")


def not_blocked(candidates: DataFrame, block_list: DataFrame) -> DataFrame:
    return candidates.join(block_list.select("idx"), "idx", "left_anti")


def top_n(scored: DataFrame, n: int) -> DataFrame:
    """The n nearest of each query, with rank; ties by id."""
    order = W.partitionBy("query_id").orderBy("dist", "idx")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def within_dp(scored: DataFrame, min_dp: float) -> DataFrame:
    return scored.where(F.col("dist") <= (2 - 2 * min_dp) ** 0.5)


def true_neighbors(scored: DataFrame, min_dp: float, topk: int) -> DataFrame:
    """The best of an exhaustive search: integer score above the limit, most first, ties by id."""
    good = scored.withColumn("score", integer_score(F.col("cosine"))).where(F.col("score") > int(min_dp * MAX_SCORE))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "idx")
    return good.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= topk)


def nearest(scored: DataFrame) -> DataFrame:
    return scored.groupBy("query_id").agg(F.min_by("idx", F.struct("dist", "idx")).alias("idx"), F.min("dist").alias("dist"))


def pair_edges(neighbors: DataFrame, peaks: DataFrame, norms: DataFrame, tolerance: int) -> DataFrame:
    """(query_id, source, target, dp, cosine, dist) of all pairs among each query's neighbours.

    Few neighbours a query, so pairs are few; only their peaks are joined, as one
    array a spectrum, and a pair is scored within its row. Nothing is expanded by
    the tolerance: a pair's exchange carries two arrays of 50 peaks at most.
    """
    a, b = neighbors.select("query_id", F.col("idx").alias("source"), F.col("rank").alias("ra")), neighbors.select("query_id", F.col("idx").alias("target"), F.col("rank").alias("rb"))
    pairs = a.join(b, "query_id").where("ra < rb").select("query_id", "source", "target")
    once = pairs.select("source", "target").distinct()
    ends = neighbors.select(F.col("idx").alias("spec_id")).distinct()
    lists = among(peaks.where("bin > 0"), ends, "spec_id").groupBy("spec_id").agg(F.sort_array(F.collect_list(F.struct("w", "bin")), asc=False).alias("p"))
    n = lists.join(norms.select("spec_id", "norm2"), "spec_id")
    met = once.join(n.select(F.col("spec_id").alias("source"), F.col("p").alias("sp"), F.col("norm2").alias("n1")), "source", "left").join(
        n.select(F.col("spec_id").alias("target"), F.col("p").alias("tp"), F.col("norm2").alias("n2")), "target", "left"
    )
    scored = met.select("source", "target", pair_dp(F.col("sp"), F.col("tp"), tolerance).alias("dp"), "n1", "n2")
    scored = scored.withColumn("cosine", F.coalesce(F.col("dp") / F.sqrt(F.col("n1").cast("double") * F.col("n2")), F.lit(0.0))).withColumn("dist", distance(F.col("cosine")))
    return pairs.join(scored.drop("n1", "n2"), ["source", "target"])


def candidate_dp(pairs: DataFrame, queries: DataFrame, peaks: DataFrame, tolerance: int, once: bool = True) -> DataFrame:
    """(query_id, idx, dp) of given pairs (query_id, idx): both spectra come to the pair as one array each; pairs without a shared peak go."""

    def lists(p: DataFrame, key: str, name: str) -> DataFrame:
        return p.where("bin > 0").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("w", "bin")), asc=False).alias(name))

    met = pairs.join(lists(queries, "query_id", "sp"), "query_id").join(lists(peaks.withColumnRenamed("spec_id", "idx"), "idx", "tp"), "idx")
    return met.select("query_id", "idx", pair_dp(F.col("sp"), F.col("tp"), tolerance, once).alias("dp")).where("dp > 0")


def pair_dp(source: Column, target: Column, tolerance: int, once: bool = True) -> Column:
    """The exact score of two arrays of (w, bin), the heaviest first: a column expression.

    A target peak meets the heaviest source peak within the tolerance, and of the
    target peaks that meet one source peak the heaviest counts, or all if not ``once``.
    """
    last = BINS + 1 - tolerance

    def near(p: Column, q: Column) -> Column:
        return (q["bin"] >= p["bin"] - tolerance) & (q["bin"] <= F.when(p["bin"] >= last, F.lit(last)).otherwise(p["bin"] + tolerance))

    def met(q: Column) -> Column:
        return F.struct(F.get(F.filter(source, lambda p: near(p, q)), F.lit(0))["w"].alias("v"), q["w"].alias("cw"))

    hits = F.filter(F.transform(target, met), lambda h: h["v"].isNotNull())
    start = F.struct(F.lit(0).cast("bigint").alias("dp"), F.array().cast("array<int>").alias("used"))

    def step(acc: Column, h: Column) -> Column:
        fresh = ~F.array_contains(acc["used"], h["v"]) if once else F.lit(True)
        return F.when(fresh, F.struct((acc["dp"] + h["v"] * h["cw"]).cast("bigint").alias("dp"), F.array_append(acc["used"], h["v"].cast("int")).alias("used"))).otherwise(acc)

    return F.coalesce(F.aggregate(hits, start, step, lambda acc: acc["dp"]), F.lit(0).cast("bigint"))


def union_of_indexes(per_index: DataFrame) -> DataFrame:
    """Candidates of several indexes (query_id, idx, index_no, rank, ...) once each; the first index, then the best rank, wins."""
    order = F.struct("index_no", "rank")
    return per_index.where("idx >= 0").groupBy("query_id", "idx").agg(F.min(order).alias("o")).select("query_id", "idx", "o.index_no", "o.rank")


def recall_at(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(rank, found, total, cumulative_found, cumulative_total): how many true neighbours of each rank were found.

    found: (query_id, idx); truth: (query_id, idx, rank).
    """
    marked = truth.join(found.select("query_id", "idx").distinct().withColumn("hit", F.lit(1)), ["query_id", "idx"], "left")
    by_rank = marked.groupBy("rank").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("total"))
    upto = W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return by_rank.withColumn("cumulative_found", F.sum("found").over(upto)).withColumn("cumulative_total", F.sum("total").over(upto))


def peptide_recall(neighbors: DataFrame, peptides: DataFrame, ranks: int = 10) -> DataFrame:
    """(rank, found, total): of queries whose peptide another spectrum has too, how many have such a one among the first ``rank`` neighbours.

    neighbors: (query_id, idx, rank), peptides: (id, peptide) of sure annotations; I and L are alike.
    """
    known = peptides.select("id", F.translate("peptide", "I", "L").alias("p"))
    several = known.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("p")
    asked = known.join(several, "p").select(F.col("id").alias("query_id"), "p").join(neighbors.select("query_id").distinct(), "query_id", "left_semi")
    others = neighbors.where("idx <> query_id").join(known.select(F.col("id").alias("idx"), F.col("p").alias("q")), "idx").join(asked, "query_id").where("p = q")
    first = asked.join(others.groupBy("query_id").agg(F.min("rank").alias("first")), "query_id", "left")
    each = first.select(F.explode(F.sequence(F.lit(1), F.lit(ranks))).alias("rank"), "first")
    return each.groupBy("rank").agg(F.count_if(F.col("first") <= F.col("rank")).alias("found"), F.count(F.lit(1)).alias("total"))


def convolution(pairs: DataFrame, queries: DataFrame, peaks: DataFrame, most: int) -> DataFrame:
    """(query_id, idx, shift, weight): sums of products of peaks whose bins differ by each shift of at most ``most`` bins. pairs: (query_id, idx)."""
    q = pairs.join(queries.select("query_id", F.col("bin").alias("qb"), F.col("w").alias("qw")), "query_id")
    c = among(peaks.select(F.col("spec_id").alias("idx"), "bin", "w"), pairs.select("idx").distinct(), "idx")
    met = q.join(c, "idx").where(F.abs(F.col("bin") - F.col("qb")) <= most)  # of given pairs, 50 by 50 peaks at most
    return met.groupBy("query_id", "idx", (F.col("bin") - F.col("qb")).alias("shift")).agg(F.sum(F.col("w") * F.col("qw")).cast("bigint").alias("weight"))


def unmatched(query: DataFrame, candidates: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(query peaks a pair, candidate peaks) without those that meet: peaks of one pair within the tolerance, which are dealt by buckets of it.

    query: (query_id, mz, w), candidates: (query_id, idx, mz, w); the first result has idx too.
    """
    pairs = candidates.select("query_id", "idx").distinct()
    own = query.join(pairs, "query_id")
    bucket = F.floor(F.col("mz") / tolerance)
    near = own.select("query_id", "idx", F.col("mz").alias("qm"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("k"))
    met = near.join(candidates.select("query_id", "idx", "mz", bucket.alias("k")), ["query_id", "idx", "k"]).where(F.abs(F.col("qm") - F.col("mz")) <= tolerance)
    left = own.join(met.select("query_id", "idx", F.col("qm").alias("mz")).distinct(), ["query_id", "idx", "mz"], "left_anti")
    return left, candidates.join(met.select("query_id", "idx", "mz").distinct(), ["query_id", "idx", "mz"], "left_anti")


def delta_mass(query: DataFrame, candidates: DataFrame, width: float = 0.05, least: float = 3000, count: int = 2) -> DataFrame:
    """(query_id, idx, delta, n, weight): groups of differences of peaks within ``width``, frequent and heavy enough; see unmatched for the peaks to give."""
    pairs = query.select("query_id", F.col("mz").alias("qm"), F.col("w").alias("qw")).join(candidates.select("query_id", "idx", "mz", "w"), "query_id")
    diff = pairs.select("query_id", "idx", (F.col("mz") - F.col("qm")).alias("delta"), (F.col("w") * F.col("qw")).alias("ww"))
    ahead = f"over (partition by query_id, idx order by delta range between current row and {float(width)!r}D following)"
    out = diff.withColumn("n", F.expr(f"count(1) {ahead}")).withColumn("weight", F.expr(f"sum(ww) {ahead}"))
    return out.where((F.col("n") > count) & (F.col("weight") > least)).drop("ww")
