"""The engine's queries over the general tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import proxies as P
from .functions import scalar
from .operators import allpairs, annotation, encode, graph, metrics, score, stats, timeseries, vector_index
from .plans.config import MAX_SCORE, IndexSpec

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Common table expressions of the SQL side, by name, with what each needs.
CTES = {
    "raw": ((), "select o_custkey spec_id, 1 + l_partkey % 2000 bin, l_extendedprice inten, l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey"),
    "top": (("raw",), "select spec_id, rank, bin, 51 - rank w from (select *, row_number() over (partition by spec_id order by inten desc, l_orderkey, l_linenumber) rank from raw) where rank <= 50"),
    "peaks": (("top",), "select * from top a where not exists (select 1 from top b where b.spec_id = a.spec_id and b.w > a.w and abs(b.bin - a.bin) <= 2)"),
    "norms": (("peaks",), "select spec_id, count(*) n_peaks, sum(w * w) norm2 from peaks group by 1"),
    "q": (("peaks",), "select spec_id query_id, bin, w from peaks where spec_id % 50 = 0"),
    "qx": (("q",), "select query_id, bin + d bin, max(w) v from q, (values (-1), (0), (1)) t(d) where bin + d > 0 group by 1, 2"),
    "hits": (("qx", "peaks"), "select query_id, p.spec_id idx, v, p.w cw from qx join peaks p on p.bin = qx.bin"),
    "dp": (("hits",), "select query_id, idx, sum(v * cw) dp from (select query_id, idx, v, max(cw) cw from hits group by 1, 2, 3) group by 1, 2"),
    "scored": (
        ("dp", "norms"),
        "select *, case when 1 - cosine < 1e-8 then 0.0 else sqrt(2.0) * sqrt(1 - cosine) end dist from (select query_id, idx, dp, c.n_peaks, "
        "least(1.0, dp / sqrt(a.norm2::double * c.norm2::double)) cosine from dp join norms a on a.spec_id = query_id join norms c on c.spec_id = idx)",
    ),
    "ranked": (("scored",), "select *, row_number() over (partition by query_id order by dist, idx) rank from scored where n_peaks > 6"),
    "nn": (("ranked",), "select * from ranked where rank <= 10"),
    "bg": (
        ("hits", "norms"),
        "select query_id, idx, dp, least(42925, floor(42925 * dp / sqrt(a.norm2::double * c.norm2::double)))::int score "
        "from (select query_id, idx, sum(v * cw) dp from hits group by 1, 2) join norms a on a.spec_id = query_id join norms c on c.spec_id = idx",
    ),
    "hist": (
        ("bg",),
        "select query_id, floor((score - low) / step)::bigint k, count(*) n, min(low) + floor((score - low) / step) * min(step) boundary from bg join "
        "(select query_id, min(score)::double low, max(score)::double high, (max(score) - min(score))::double / 10000 step from bg group by 1) using (query_id) where step >= 1e-10 group by query_id, floor((score - low) / step)",
    ),
    "surv": (
        ("hist",),
        "select query_id, boundary, sum(n) over (partition by query_id order by boundary desc rows unbounded preceding)::double / sum(n) over (partition by query_id) survival, sum(n) over (partition by query_id) total "
        "from hist where boundary > 1e-3",
    ),
    "pts": (
        ("surv",),
        "select query_id, boundary x, log10(survival) y, total from (select *, lag(survival) over (partition by query_id order by boundary desc) before from surv) where before is null or before <= 0.1",
    ),
    "fits": (
        ("pts",),
        "select query_id, lo, count(*) n, regr_slope(y, x) k, regr_intercept(y, x) b, regr_r2(y, x) r2 from pts, (select round(-2.5 + 0.1 * i, 1) lo from range(15) t(i)) where y <= -1 and y >= lo group by 1, 2",
    ),
    "model": (("fits",), "select * from (select *, row_number() over (partition by query_id order by lo) rn from fits where n >= 50 and r2 >= 0.95) where rn = 1"),
    "pv": (
        ("nn", "model", "pts", "norms"),
        "select query_id, idx, rank, case when k is null then 10000.0 when q > 0.1 or isnan(q) then 1.0 else q end p from (select n.query_id, n.idx, n.rank, k, "
        "case when pow(10.0, k * 42925 * cosine + b) >= 1 then 1.0 else 1 - pow(1 - pow(10.0, k * 42925 * cosine + b), t.total) end q "
        "from nn n left join model m on m.query_id = n.query_id left join (select query_id, max(total) total from pts group by 1) t on t.query_id = n.query_id)",
    ),
    "gt": (
        (),
        "select c_custkey id, c_nationkey file_id, c_mktsegment peptide, c_custkey::int scan, (1 + c_custkey % 4)::int charge, c_acctbal score, (c_acctbal > 0)::int significance, "
        "(c_custkey % 10 = 0)::int isdecoy, trunc(abs(c_acctbal % 100))::int energy from customer",
    ),
    "sf": (
        (),
        "select file_id, '/data/' || n_name || '.mzML' filename, (sum(n) over (order by file_id rows unbounded preceding) - n)::bigint start, (sum(n) over (order by file_id rows unbounded preceding))::bigint \"end\" "
        "from (select c_nationkey file_id, count(*) n from customer group by 1) join nation on n_nationkey = file_id",
    ),
    "vec": (("peaks",), "select spec_id, slot, sum(x) x from (select spec_id, least(bin, 2001) + d slot, case when d = 0 then w else w / 2.0 end x from peaks, (values (-1), (0), (1)) t(d)) where slot between 0 and 2001 group by 1, 2"),
    "qv": (("vec",), "select * from vec where spec_id % 50 = 0"),
    "pt": ((), "select event_id scan, floor(epoch(ts))::double rt, user_id::double mz, value intensity, event_type level from events"),
}
VECTOR_SLOTS = 2002


def sql(body: str, *names: str) -> str:
    """body behind the common table expressions that it names, and theirs."""
    order: list[str] = []

    def need(x: str) -> None:
        for y in CTES[x][0]:
            need(y)
        if x not in order:
            order.append(x)

    for x in names:
        need(x)
    return ("with " + ", ".join(f"{x} as materialized ({CTES[x][1]})" for x in order) + " " if order else "") + body


def query(text: str | None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text, *names)
        return f

    return add


def r6(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


# --- shared steps ---------------------------------------------------------------------------


def _norms(p: DataFrame):
    n = encode.norms(p)
    return n, n.select(F.col("spec_id").alias("query_id"), F.col("norm2").alias("qnorm2")), n.select(F.col("spec_id").alias("idx"), F.col("norm2").alias("cnorm2"))


def _scored(spark, d) -> DataFrame:
    p = P.peaks(spark, d)
    n, qn, cn = _norms(p)
    return score.with_cosine(score.exact_dp(P.queries_of(p), P.candidates_of(p), P.TOLERANCE), qn, cn).join(n.select(F.col("spec_id").alias("idx"), "n_peaks"), "idx")


def _neighbors(spark, d, n: int = 10, p: DataFrame | None = None) -> DataFrame:
    """(query_id, idx, dp, n_peaks, cosine, dist, rank), written once, since queries read it several times."""
    p = P.peaks(spark, d) if p is None else p
    return P.stored(allpairs.nearest(P.queries_of(p), P.candidates_of(p), P.TOLERANCE, n, 6), "neighbors")


def _true(p: DataFrame) -> DataFrame:
    """(query_id, idx, rank, score): the ten of highest score above a tenth, ties by id."""
    near = allpairs.nearest(P.queries_of(p), P.candidates_of(p), P.TOLERANCE, 10, min_score=int(0.1 * MAX_SCORE))
    return near.select("query_id", "idx", "rank", score.integer_score(F.col("cosine")).alias("score"))


def _background(spark, d) -> DataFrame:
    p = P.peaks(spark, d)
    return allpairs.all_dp(P.queries_of(p), P.candidates_of(p), P.TOLERANCE, once=False, scored=True)


def _counted(p: DataFrame, told, schema: str, each: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ``told`` makes of the counts of background scores, without a row a pair; see allpairs.background_rows."""
    return allpairs.background_rows(P.queries_of(p), P.candidates_of(p), P.TOLERANCE, told, schema, each)


HISTOGRAM, TAIL = "k bigint, n bigint, boundary double", "x double, survival double, total bigint"


def _points(spark, d) -> DataFrame:
    tails, _ = _counted(P.peaks(spark, d), stats.counted_tail, TAIL, each=True)
    return tails.select("query_id", "x", F.log10("survival").alias("y"), "total")


def _p_values(spark, d) -> DataFrame:
    p = P.peaks(spark, d)
    tails, alike = _counted(p, stats.counted_tail, TAIL)
    # the total goes with the key, so tails are read once
    points = tails.select(F.struct("query_id", "total").alias("key"), "x", F.log10("survival").alias("y"))
    model = stats.tail_model(points, "key").select("key.*", "k", "b")
    fits = alike.join(model, "query_id").select(F.col("same").alias("query_id"), "k", "b", "total")
    j = _neighbors(spark, d, p=p).join(fits, "query_id", "left")
    return j.select("query_id", "idx", "rank", stats.p_value(42925 * F.col("cosine"), F.col("k"), F.col("b"), F.col("total")).alias("p"))


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    p = P.peaks(spark, d)
    v = encode.binned(p, F.col("bin"), F.col("w"), bins=VECTOR_SLOTS)
    return v.where(F.col("spec_id") % P.QUERY_SET == 0), v


def _vector_classes(spark, d) -> dict:
    """left, right: the vectors of the query set and of all, one of equal spectra each."""
    p = P.peaks(spark, d)
    sides = allpairs.classes(p.where(F.col("spec_id") % P.QUERY_SET == 0), "spec_id"), allpairs.classes(p, "spec_id", dealt=True)
    return dict(zip(("left", "right"), (allpairs.class_vectors(x, VECTOR_SLOTS) for x in sides)))


# --- search -----------------------------------------------------------------------------------


@query("select query_id, idx, rank::int rank, dp::bigint dp, round(cosine, 6) cosine, round(dist, 6) dist from nn", "nn")
def topn_neighbors(spark, d):
    return _neighbors(spark, d).select("query_id", "idx", "rank", "dp", r6("cosine", "cosine"), r6("dist", "dist"))


@query("select query_id, idx, dp::bigint dp from dp", "dp")
def exact_dp_pairs(spark, d):
    p = P.peaks(spark, d)
    return allpairs.all_dp(P.queries_of(p), P.candidates_of(p), P.TOLERANCE)


@query("select query_id, idx, dp::bigint dp, round(dist, 6) dist from scored where dist <= sqrt(2 - 2 * 0.5)", "scored")
def min_dp_neighbors(spark, d):
    return score.within_dp(_scored(spark, d), 0.5).select("query_id", "idx", "dp", r6("dist", "dist"))


TRUE_NN = "select query_id, idx, row_number() over (partition by query_id order by s desc, idx)::int rank, s score from (select query_id, idx, least(42925, floor(42925 * cosine))::int s from scored) where s > 4292"


@query(f"select * from ({TRUE_NN}) where rank <= 10", "scored")
def true_nn(spark, d):
    return _true(P.peaks(spark, d)).select("query_id", "idx", "rank", "score")


@query(
    f"select rank, found, total, (sum(found) over (order by rank))::bigint cumulative_found, (sum(total) over (order by rank))::bigint cumulative_total from (select t.rank, count(f.idx)::bigint found, count(*)::bigint total "
    f"from (select * from ({TRUE_NN}) where rank <= 10) t left join (select query_id, idx from nn where rank <= 5) f using (query_id, idx) group by 1)",
    "scored", "nn",
)
def true_nn_recall(spark, d):
    p = P.peaks(spark, d)
    return score.recall_at(_neighbors(spark, d, 5, p), _true(p))


@query("select query_id, arg_min(idx, row(dist, idx)) idx, round(min(dist), 6) dist from scored where idx <> query_id group by 1", "scored")
def nearest_other(spark, d):
    p = P.peaks(spark, d)
    two = allpairs.nearest(P.queries_of(p), P.candidates_of(p), P.TOLERANCE, 2)  # one of them can be the query itself
    return score.nearest(two.where("idx <> query_id")).select("query_id", "idx", r6("dist", "dist"))


EDGES = (
    "with_pairs as (select a.query_id, a.idx source, b.idx target from nn a join nn b on a.query_id = b.query_id and a.rank < b.rank), "
    "once as (select distinct source, target from with_pairs), "
    "ex as (select spec_id, bin + d bin, max(w) v from peaks, (values (-1), (0), (1)) t(d) where bin + d > 0 group by 1, 2), "
    "met as (select source, target, sum(v * cw) dp from (select source, target, v, max(p.w) cw from once join ex on ex.spec_id = source join peaks p on p.spec_id = target and p.bin = ex.bin group by 1, 2, 3) group by 1, 2), "
    "edges as (select query_id, source, target, coalesce(dp, 0)::bigint dp, least(1.0, coalesce(dp, 0) / sqrt(a.norm2::double * b.norm2::double)) cosine from with_pairs left join met using (source, target) "
    "join norms a on a.spec_id = source join norms b on b.spec_id = target) "
)


def _edges(spark, d) -> DataFrame:
    p = P.peaks(spark, d)
    return score.pair_edges(_neighbors(spark, d, p=p), p, encode.norms(p), P.TOLERANCE)


@query(None)
def pairwise_edges(spark, d):
    return _edges(spark, d).select("query_id", "source", "target", "dp", r6("dist", "dist"))


SQL["pairwise_edges"] = (
    sql("", "nn", "norms", "peaks").rstrip() + ", " + EDGES + "select query_id, source, target, dp, round(case when 1 - cosine < 1e-8 then 0.0 else sqrt(2.0) * sqrt(1 - cosine) end, 6) dist from edges"
)


@query(
    "select query_id, id, peptide, (1 + dense_rank() over (partition by query_id order by first))::int \"group\" from (select *, min(id) over (partition by query_id, peptide) first from "
    "(select distinct n.query_id, n.id, g.peptide from (select query_id, idx id from nn union select query_id, query_id from nn) n join gt g on g.id = n.id))",
    "nn", "gt",
)
def node_groups(spark, d):
    e = _neighbors(spark, d).select("query_id", F.col("query_id").alias("source"), F.col("idx").alias("target"))
    return graph.grouped(graph.nodes(e), P.ground_truth(spark, d)).select("query_id", "id", "peptide", F.col("group").cast("int").alias("group"))


@query("select query_id, query_id source, idx target, round(dist, 6) dist from nn where idx <> query_id", "nn")
def graph_links(spark, d):
    return graph.links(_neighbors(spark, d)).select("query_id", "source", "target", r6("dist", "dist"))


@query("select rank::int rank, count(*)::bigint n from nn group by 1", "nn")
def rank_histogram(spark, d):
    return stats.ranking_histogram(_neighbors(spark, d)).select("rank", "n")


# --- statistics -------------------------------------------------------------------------------


@query("select query_id, idx, dp::bigint dp, score from bg", "bg")
def background_scores(spark, d):
    return _background(spark, d)


@query("select query_id, k, n::bigint n, round(boundary, 4) boundary from hist", "hist")
def score_histogram(spark, d):
    counts, _ = _counted(P.peaks(spark, d), stats.counted_histogram, HISTOGRAM, each=True)
    return counts.select("query_id", "k", "n", r6("boundary", "boundary", 4))


@query("select query_id, round(boundary, 4) boundary, round(survival, 6) survival from surv", "surv")
def survival_tail(spark, d):
    counts, _ = _counted(P.peaks(spark, d), stats.counted_histogram, HISTOGRAM, each=True)
    return stats.survival(counts).select("query_id", r6("boundary", "boundary", 4), r6("survival", "survival"))


@query("select query_id, lo::double lo, n::bigint n, round(k, 8) k, round(b, 5) b, round(r2, 5) r2 from model", "model")
def tail_regression(spark, d):
    return stats.tail_model(_points(spark, d)).select("query_id", "lo", "n", r6("k", "k", 8), r6("b", "b", 5), r6("r2", "r2", 5))


@query("select query_id, idx, round(p, 5) p from pv where rank = 1", "pv")
def tophit_pvalue(spark, d):
    return _p_values(spark, d).where("rank = 1").select("query_id", "idx", r6("p", "p", 5))


@query(
    "select coalesce(max(case when bh <= 0.01 then p end), 0.0) threshold, count(*)::bigint n, coalesce(max(case when bh <= 0.01 then upto end), 0)::bigint passed from "
    "(select p, p * count(*) over () / count(*) over (order by p range unbounded preceding) bh, count(*) over (order by p range unbounded preceding) upto from (select (rank() over (order by c_acctbal) * rank() over (order by c_acctbal))::double / (count(*) over () * count(*) over ())::double p from customer))"
)
def bh_threshold(spark, d):
    c = P.table(spark, d, "customer").groupBy("c_acctbal").agg(F.count(F.lit(1)).alias("c"))
    own = stats.running(c, "c_acctbal", {"upto": "c"})
    least = F.col("upto") - F.col("c") + 1
    p = (least * least).cast("double") / (F.col("upto_total") * F.col("upto_total")).cast("double")
    rows = own.select(p.alias("p"), F.explode(F.sequence(F.lit(1), F.col("c"))).alias("i"))
    return stats.bh_threshold(rows.select("p"))


@query(
    "select score, (sum(t) over w)::bigint targets, (sum(d) over w)::bigint decoys, round((sum(d) over w)::double / greatest(sum(t) over w, 1), 6) fdr from "
    "(select score, sum(1 - isdecoy) t, sum(isdecoy) d from gt group by 1) window w as (order by score desc rows unbounded preceding)",
    "gt",
)
def target_decoy_fdr(spark, d):
    g = P.ground_truth(spark, d).select("score", F.col("isdecoy").alias("is_decoy"))
    return stats.target_decoy_curve(g).select("score", "targets", "decoys", r6("fdr", "fdr"))


def _second(spark, d) -> DataFrame:
    o = P.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("spec_id")).agg(F.min("o_orderpriority").alias("pr"))
    c = P.table(spark, d, "customer").select(F.col("c_custkey").alias("spec_id"), "c_mktsegment")
    return o.join(c, "spec_id").select("spec_id", F.when(F.col("pr") == "1-URGENT", F.col("c_mktsegment")).otherwise(F.col("pr")).alias("peptide"))


@query(
    "select count(*) filter (where p1 = p2)::bigint same, count(*) filter (where p1 <> p2)::bigint different, count(*) filter (where p1 is not null and p2 is null)::bigint only_first, "
    "count(*) filter (where p1 is null and p2 is not null)::bigint only_second, round(count(*) filter (where p1 = p2) / nullif(count(p2), 0)::double, 6) recall from (select id spec_id, replace(peptide, 'I', 'L') p1 from gt where significance = 1) full join "
    "(select spec_id, replace(case when pr = '1-URGENT' then c_mktsegment else pr end, 'I', 'L') p2 from (select o_custkey spec_id, min(o_orderpriority) pr from orders group by 1) join customer on c_custkey = spec_id) using (spec_id)",
    "gt",
)
def venn_counts(spark, d):
    first = P.ground_truth(spark, d).where("significance = 1").select(F.col("id").alias("spec_id"), "peptide")
    return stats.agreement(first, _second(spark, d)).withColumn("recall", F.round("recall", 6))


@query(
    "select query_id, min(rank)::int rank from nn join gt g on g.id = idx join gt q on q.id = query_id where g.significance = 1 and replace(g.peptide, 'I', 'L') = replace(q.peptide, 'I', 'L') group by 1",
    "nn", "gt",
)
def first_match_rank(spark, d):
    g = P.ground_truth(spark, d)
    n = _neighbors(spark, d).select("query_id", "idx", "rank").join(g.select(F.col("id").alias("idx"), "peptide", "significance"), "idx")
    return stats.first_match_rank(n, g.select(F.col("id").alias("query_id"), "peptide"))


@query(
    "select 'charge' kind, case when charge between 1 and 7 then charge::varchar else 'other' end value, count(*)::bigint n from gt group by 2 union all "
    "select 'length', case when length(peptide) between 1 and 100 then length(peptide)::varchar else 'other' end, count(*)::bigint from gt group by 2",
    "gt",
)
def charge_length_summary(spark, d):
    return stats.charge_length_summary(P.ground_truth(spark, d))


@query("select round(-sum(p * ln(p)), 6) entropy, count(*)::bigint n_values from (select count(*)::double / sum(count(*)) over () p from gt group by peptide)", "gt")
def peptide_entropy(spark, d):
    return stats.entropy(P.ground_truth(spark, d), "peptide").select(r6("entropy", "entropy"), "n_values")


@query(
    "select round(avg(x), 4) mean, round(stddev_pop(x), 4) std, round(exp(avg(ln(x))), 4) geometric, round(1 / avg(1 / x), 4) harmonic, round(sqrt(avg(x * x)), 4) quadratic, round(pow(avg(x * x * x), 1.0 / 3), 4) cubic "
    "from (select p_retailprice x from part)"
)
def price_means(spark, d):
    m = stats.means(P.table(spark, d, "part"), "p_retailprice")
    return m.select(*[r6(c, c, 4) for c in m.columns])


# --- annotation ---------------------------------------------------------------------------------


@query("select file_id, filename, start, \"end\" from sf", "sf")
def spec_file_offsets(spark, d):
    return annotation.file_ranges(P.spec_files(spark, d))


@query("select max(\"end\")::bigint total, max(file_id) last_file, count(*)::bigint n_files from sf", "sf")
def total_spectra(spark, d):
    return annotation.total_spectra(annotation.file_ranges(P.spec_files(spark, d)))


@query("select id, file_id, peptide, scan, score, filename from gt join sf using (file_id) where peptide = 'BUILDING' order by id limit 10", "gt", "sf")
def search_peptide(spark, d):
    out = annotation.search_peptide(P.ground_truth(spark, d), annotation.file_ranges(P.spec_files(spark, d)), "BUILDING")
    return out.select("id", "file_id", "peptide", "scan", "score", "filename")


DENSE = (
    "g as (select start + row_number() over (partition by file_id order by id) - 1 id, file_id, scan, filename, start, \"end\" from gt join sf using (file_id)), "
    "f as (select file_id from sf where filename like '%NATION_1%' order by 1 limit 10) "
)


@query(None)
def search_file_scan(spark, d):
    files = annotation.file_ranges(P.spec_files(spark, d))
    # ids as an archive gives them: dense within files, in the order of files
    place = F.row_number().over(W.partitionBy("file_id").orderBy("id")) - 1
    g = P.ground_truth(spark, d).withColumn("__p", place).join(files.select("file_id", F.col("start").alias("__s")), "file_id").withColumn("id", F.col("__s") + F.col("__p")).drop("__p", "__s")
    wrong = g.where("id % 11 = 0").withColumn("id", F.col("id") + (1 << 40))  # beyond any file's range
    return annotation.search_scan(g.where("id % 11 <> 0").unionByName(wrong), files, "NATION_1", 10, 400).select("id", "file_id", "scan", "filename")


SQL["search_file_scan"] = sql("", "gt", "sf").rstrip() + ", " + DENSE + "select id, file_id, scan, filename from g where id % 11 <> 0 and scan between 10 and 400 and file_id in (select file_id from f) order by file_id, id limit 100"


@query("select peptide, coalesce(known, false) known from (select distinct peptide from gt) left join (select distinct peptide, true known from gt where significance = 1 and file_id not in (0, 1, 2)) using (peptide)", "gt")
def in_search_space(spark, d):
    g = P.ground_truth(spark, d)
    excluded = P.spec_files(spark, d).where("file_id < 3").select("file_id")
    return annotation.in_search_space(g.select("peptide").distinct(), g, excluded)


@query(
    "select id, score from (select id, case when u is not null then u else score end score from gt left join (select o_custkey scan, max(o_totalprice) u from orders group by 1) using (scan))", "gt"
)
def annotation_update(spark, d):
    g, files = P.ground_truth(spark, d), annotation.file_ranges(P.spec_files(spark, d))
    orders = P.table(spark, d, "orders").select(F.col("o_custkey").cast("int").alias("scan"), F.col("o_totalprice").alias("score"))
    names = g.join(files.select("file_id", "filename"), "file_id").select("scan", "filename")
    return annotation.updated(g, files, orders.join(names, "scan").select("filename", "scan", "score")).select("id", "score")


@query("select id, file_id from gt where file_id <= (select max(file_id) - 3 from sf)", "gt", "sf")
def delete_last_n(spark, d):
    return annotation.without_last(P.ground_truth(spark, d), annotation.file_ranges(P.spec_files(spark, d)), 3).select("id", "file_id")


@query("select count(*) filter (where \"end\" > 1000)::bigint n from sf", "sf")
def shrink_to_size(spark, d):
    return annotation.files_to_remove(annotation.file_ranges(P.spec_files(spark, d)), 1000)


@query(
    "select id idx from (select *, row_number() over (partition by file_id, run order by abs(energy - 35), id) k from (select *, sum(change) over (partition by file_id order by id rows unbounded preceding) run from "
    "(select *, case when lag(peptide) over w = peptide and lag(charge) over w = charge then 0 else 1 end change from (select id, file_id, peptide, energy, (scan % 2) charge from gt) window w as (partition by file_id order by id)))) where k > 1",
    "gt",
)
def blocklist_ce(spark, d):
    g = P.ground_truth(spark, d).withColumn("ce", F.concat(F.col("energy").cast("string"), F.lit(" eV"))).withColumn("charge", F.col("scan") % 2)
    # energies lose their two last characters; " eV" has three, so one more is put on
    return annotation.block_list_energy(g.withColumn("ce", F.regexp_replace("ce", " eV$", "eV")))


@query("select id, case when charge = 1 then round(111.0 * length(peptide) / (score + 2000))::int else charge end charge from gt", "gt")
def charge_repair(spark, d):
    g = P.ground_truth(spark, d)
    zero = F.when(F.col("charge") == 1, F.lit(0)).otherwise(F.col("charge"))
    return g.select("id", scalar.repaired_charge(zero, F.col("peptide"), F.col("score") + 2000).alias("charge"))


@query(None)
def theoretical_ions(spark, d):
    peptides = P.table(spark, d, "nation").select(F.col("n_nationkey").alias("spec_id"), F.regexp_replace("n_name", "[^GASPVTCLINDQKEMHFRYW]", "").alias("peptide"), F.lit(2).alias("charge"))
    return scalar.theoretical_ions(peptides.where(F.length("peptide") > 1)).select("spec_id", "kind", "position", "z", r6("mz", "mz", 5))


SQL["theoretical_ions"] = (
    "with m(a, mass) as (values " + ", ".join(f"('{a}', {x}::double)" for a, x in scalar.RESIDUES.items()) + "), "
    "p as (select n_nationkey spec_id, regexp_replace(n_name, '[^GASPVTCLINDQKEMHFRYW]', '', 'g') s from nation), "
    "r as (select spec_id, i, length(s) n, mass from p, range(1, 60) t(i), m where i <= length(s) and a = s[i]), "
    "c as (select spec_id, i, n, sum(mass) over (partition by spec_id order by i rows unbounded preceding) b, sum(mass) over (partition by spec_id) t from r), "
    "ions as (select spec_id, 'b' kind, i position, b mass from c where i < n union all select spec_id, 'y', n - i, t - b + 18.010565 from c where i < n) "
    "select spec_id, kind, position::int position, z::int z, round((mass + z * 1.007276) / z, 5) mz from ions, (values (1), (2)) v(z)"
)


# --- encoding and metrics --------------------------------------------------------------------


@query("select spec_id, rank::int rank, bin::int bin, w::int w from peaks", "peaks")
def encoded_peaks(spark, d):
    return P.peaks(spark, d)


@query("select spec_id, slot::int slot, x::double x from vec", "vec")
def peak_binning_flank(spark, d):
    return _vectors(spark, d)[1].select("spec_id", "slot", "x")


@query("select spec_id, slot::int slot, round(x / sqrt(sum(x * x) over (partition by spec_id)), 6) x from vec", "vec")
def l2_norm(spark, d):
    return encode.l2_normalised(_vectors(spark, d)[1]).select("spec_id", "slot", r6("x", "x"))


@query("select n_peaks::bigint n_peaks, count(*)::bigint n_spectra from norms group by 1", "norms")
def peak_count_hist(spark, d):
    return encode.peak_count_histogram(P.peaks(spark, d))


PAIR = "(select a.spec_id a, b.spec_id b, a.x x, b.x y from qv a join vec b using (slot))"
N2 = "(select spec_id, sum(x) s, sum(x * x) q, count(*) n from vec group by 1)"


def _similarity(f):
    if f is metrics.jensen_shannon:
        return lambda spark, d: f(*_vectors(spark, d)).select("a", "b", r6("similarity", "similarity"))
    return lambda spark, d: f(**_vector_classes(spark, d), digits=6)


for _name, _f, _text in (
    ("cosine_bins", metrics.cosine, f"select p.a, p.b, round(sum(x * y) / sqrt(max(m.q)) / sqrt(max(n.q)), 6) similarity from {PAIR} p join {N2} m on m.spec_id = p.a join {N2} n on n.spec_id = p.b group by 1, 2"),
    ("pearson_bins", lambda **kw: metrics.pearson(slots=VECTOR_SLOTS, **kw),
     f"select p.a, p.b, round(((2002 * sum(x * y) - max(m.s) * max(n.s)) / (sqrt(2002 * max(m.q) - max(m.s) ** 2) * sqrt(2002 * max(n.q) - max(n.s) ** 2)) + 1) / 2, 6) similarity from {PAIR} p join {N2} m on m.spec_id = p.a join {N2} n on n.spec_id = p.b group by 1, 2"),
    ("pnorm_bins", metrics.p_norm, f"select p.a, p.b, round(1 - sqrt(greatest(0, sum(-2 * x * y) + max(m.q) + max(n.q))) / (sqrt(max(m.q)) + sqrt(max(n.q))), 6) similarity from {PAIR} p join {N2} m on m.spec_id = p.a join {N2} n on n.spec_id = p.b group by 1, 2"),
    ("jaccard_bins", metrics.jaccard, f"select p.a, p.b, round(count(*) / (max(m.n) + max(n.n) - count(*))::double, 6) similarity from {PAIR} p join {N2} m on m.spec_id = p.a join {N2} n on n.spec_id = p.b group by 1, 2"),
    ("jsd_bins", metrics.jensen_shannon,
     f"select a, b, round(1 - ln(2.0) - sum((u * ln(u / ((u + v) / 2)) + v * ln(v / ((u + v) / 2)) - (u + v) * ln(2.0)) / 2), 6) similarity from (select p.a, p.b, x / m.s u, y / n.s v from {PAIR} p join {N2} m on m.spec_id = p.a join {N2} n on n.spec_id = p.b) group by 1, 2"),
):
    QUERIES[_name] = _similarity(_f)
    SQL[_name] = sql(_text, "vec", "qv")


# --- vectors -----------------------------------------------------------------------------------


def _knn(spark, d, k: int = 10) -> DataFrame:
    v = P.vectors(spark, d)
    return vector_index.knn(v.where(F.col("idx") % P.QUERY_SET == 0).select(F.col("idx").alias("query_id"), F.col("v").alias("q")), v, k)


@query(
    "select query_id, idx, rank::int rank, round(dist, 4) dist from (select *, row_number() over (partition by query_id order by round(dist, 9), idx) rank from (select a.vec_id query_id, b.vec_id idx, "
    "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::double - x[2]::double) ** 2)) dist from embeddings a, embeddings b where a.vec_id % 50 = 0)) where rank <= 10"
)
def knn_exact(spark, d):
    return _knn(spark, d).select("query_id", "idx", "rank", r6("dist", "dist", 4))


def _indexes(spark, d):
    return vector_index.train_all(P.vectors(spark, d), [(IndexSpec(16, 16), 1), (IndexSpec(16, 16), 2)])


@query(None)
def ivf_search(spark, d):
    v = P.vectors(spark, d)
    q = v.where(F.col("idx") % P.QUERY_SET == 0).select(F.col("idx").alias("query_id"), F.col("v").alias("q"))
    return vector_index.search_all(q, v, _indexes(spark, d), 64, 8)


@query(None)
def ann_recall(spark, d):
    return score.recall_at(ivf_search(spark, d), _knn(spark, d).select("query_id", "idx", "rank"))


@query(None)
def ivf_entropy(spark, d):
    return vector_index.list_entropy(vector_index.encoded(P.vectors(spark, d), _indexes(spark, d)[0]))


# --- time series -------------------------------------------------------------------------------

XIC = "t as (select scan target_id, mz, rt from pt where level = 'purchase' and scan % 50 = 0), s as (select scan, rt from pt where level = 'view'), "


def _targets(spark, d):
    p = P.points(spark, d)
    return p.where((F.col("level") == "purchase") & (F.col("scan") % P.QUERY_SET == 0)).select(F.col("scan").alias("target_id"), "mz", "rt"), p.where("level = 'view'")


@query(None)
def xic(spark, d):
    t, s = _targets(spark, d)
    return timeseries.chromatogram(t, s.select("scan", "rt"), s.select("scan", "mz", "intensity"), 10.0, 3600.0)


SQL["xic"] = sql("", "pt").rstrip() + ", " + XIC + (
    "n as (select target_id, s.scan, s.rt, t.mz from t join s on s.rt > t.rt - 3600 and s.rt < t.rt + 3600 where t.rt >= (select min(rt) from s)) "
    "select target_id, n.scan, n.rt, coalesce(p.mz, n.mz) mz, coalesce(p.intensity, 0.0) intensity from n left join pt p on p.scan = n.scan and p.mz > n.mz - 10 and p.mz <= n.mz + 10"
)


@query("select scan target_id, i::int isotope, round(mz + i * 1.0032 / 2, 6) mz from pt, range(-1, 4) t(i) where level = 'purchase' and scan % 50 = 0", "pt")
def isotope_traces(spark, d):
    t, _ = _targets(spark, d)
    return timeseries.isotope_targets(t.withColumn("charge", F.lit(2))).select("target_id", "isotope", r6("mz", "mz"))


@query(
    "select px::int px, py::int py, count(*)::bigint n, round(sum(intensity), 4) total, round(avg(mz), 4) mean_mz, round(avg(rt), 2) mean_rt, round(ln(sum(intensity) + 1), 6) log_total from "
    "(select least(99, floor((rt - r0) / (r1 - r0) * 100)) px, least(99, floor((mz - m0) / (m1 - m0) * 100)) py, rt, mz, intensity from pt, (select min(rt) r0, max(rt) r1, min(mz) m0, max(mz) m1 from pt)) group by 1, 2",
    "pt",
)
def mzrt_pixels(spark, d):
    p = timeseries.pixels(P.points(spark, d))
    return p.select("px", "py", "n", r6("total", "total", 4), r6("mean_mz", "mean_mz", 4), r6("mean_rt", "mean_rt", 2), r6("log_total", "log_total"))


@query("select scan, rt from pt where (scan + 32 - 5) % 32 = 0", "pt")
def swath_window(spark, d):
    return timeseries.swath(P.points(spark, d), 5, 32).select("scan", "rt")
