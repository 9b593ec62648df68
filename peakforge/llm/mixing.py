"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w, u a hash of its id in (0, 1) and w its
quality weight. Within a source, complete epochs take all documents; the rest of
the target takes documents in the order of their keys, as far as the prefix sum
of their sizes reaches the budget. A boundary document is taken if more than
half of it fits; where words are still missing, the one document left whose size
comes nearest to the gap closes it.

Prefix sums run in two levels: (source, key bucket) sums first, then only the
one bucket per source in which the budget ends is sorted. A source that holds
a third of all rows is thus spread over ``buckets`` groups.

Documents are ordered by key, id and text hash, so that how the table is dealt
out changes nothing: rows without an id and rows that share one have an order of
their own, and only rows equal in id and text are alike to the mix.

Null texts have size 0; a document of size 0 comes 0, 1 or 2 times as any other
does, and a source of only such documents has target 0 and comes not at all. A
null source is a source of its own, ordered last. Repeated rows count once each; an
empty table gives an empty result. Only id, text and source are read, so other
columns cannot clash. There is one row a source in the plan of targets, which one
task orders: sources are counted in thousands, documents are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_broadcast, read, staged, uniform, word_count

BROADCAST_ROWS = 200_000


def quality_weight(text: Column) -> Column:
    """Weight in (0, 1]: documents with fewer symbols a word come earlier."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>!]")), F.lit(0))
    return F.lit(1.0) / (1.0 + symbols / F.greatest(word_count(text), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target of each source (source, source_size): its share by weight, none above ``most`` times its size.

    Sources in the order of their ratio limit / weight: those whose limit is
    under the level that the rest would get are filled, the level is what
    remains over the weights that remain. One row a source, no driver work.
    """
    one = W.orderBy(F.col("source").asc_nulls_last())
    n = F.pmod(F.row_number().over(one) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in weights]), n)).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = ranked.withColumn("level", level).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    # the first that is not filled has the level of all that are not filled
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    return filled.select(
        "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight"))).alias("target")
    )


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, buckets: int, seed: int) -> DataFrame:
    """docs with __id, __source, __size, __key, __hash (of the text) and __bucket (of the key)."""
    text = F.col(text_col)
    out = docs.withColumns({"__id": F.col(id_col), "__source": F.col(source_col), "__size": word_count(text), "__hash": F.xxhash64(text)})
    out = out.withColumn("__key", -F.log(uniform(F.col("__id"), F.col("__hash"), F.lit(seed))) / quality_weight(text))
    return out.withColumn("__bucket", F.least(F.lit(buckets - 1), F.floor(buckets * (1 - F.exp(-F.col("__key"))))).cast("int"))


NAMES = {"__id": "id", "__source": "source", "__size": "size", "__key": "key", "__hash": "hash", "__bucket": "bucket"}


def planned(slim: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """(rows, closing) of slim (id, source, size, key, hash, bucket, row).

    rows: slim with source_size, target, epochs, and more, 1 if the rest of the
    target takes the row; closing (row): the rows that close their sources' gaps.
    """
    sums = staged(slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    aims = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    aims = aims.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    prefix = F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = staged(
        sums.withColumn("before", prefix)
        .join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s"),
        "mix-plan",
    )
    plan = plan.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    rows = slim.join(bounded_broadcast(plan, plan.count(), BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    ends_here = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("bucket_size") > F.col("rest"))
    # where complete epochs are all, nothing more comes, not even a document of size 0
    whole = rows.where(~ends_here).withColumn("more", ((F.col("rest") > 0) & (F.col("before") + F.col("bucket_size") <= F.col("rest"))).cast("long"))
    order = W.partitionBy("source", "bucket").orderBy("key", "id", "hash", "row").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    cut = rows.where(ends_here).withColumn("more", (start + F.col("size") / 2 <= F.col("rest")).cast("long"))
    columns = [*slim.columns, "source_size", "target", "rest", "epochs", "more"]
    out = staged(whole.select(columns).unionByName(cut.select(columns)), "mix-chosen")
    gaps = out.groupBy("source").agg((F.min("rest") - F.sum(F.col("more") * F.col("size"))).alias("gap")).withColumnRenamed("source", "s")
    gaps = staged(gaps, "mix-gaps")
    gaps = bounded_broadcast(gaps, gaps.count(), BROADCAST_ROWS)
    left = out.where("more = 0 and size > 0").join(gaps, F.col("source").eqNullSafe(F.col("s"))).where("gap > 0 and size < 2 * gap")
    best = F.min(F.struct(F.abs(F.col("gap") - F.col("size")), "key", "id", "hash", "row"))
    return out, left.groupBy("source").agg(best.alias("c")).select("source", F.col("c.row").alias("row"), F.col("c.id").alias("id"), F.col("c.hash").alias("hash"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    buckets: int = 1024,
    seed: int = 7,
) -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target, repeats, taken."""
    keyed = _slim(docs, id_col, text_col, source_col, buckets, seed)
    slim = staged(keyed.select(*[F.col(k).alias(v) for k, v in NAMES.items()], F.monotonically_increasing_id().alias("row")), "mix-documents")
    out, closing = planned(slim, weights, share, most)
    out = out.join(closing.select("row", F.lit(1).alias("closes")), "row", "left").withColumn("repeats", F.col("epochs") + F.col("more") + F.coalesce("closes", F.lit(0)))
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, buckets: int = 1024, seed: int = 7) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them.

    Within a source, what the rest of the target takes are all documents up to one
    place in their order, and the one that closes the gap: a row a source, which
    is sent to the documents. No text is dealt out. Rows equal in id and text
    stand at one place and share a decision.
    """
    keyed = _slim(docs, "doc_id", "text", "source", buckets, seed)
    slim = staged(keyed.select(*[F.col(k).alias(v) for k, v in NAMES.items()], F.monotonically_increasing_id().alias("row")), "mix-documents")
    rows, closing = planned(slim, weights, share, most)
    place = F.struct("key", "id", "hash")
    ends = rows.groupBy("source").agg(F.min("epochs").alias("__epochs"), F.max(F.when(F.col("more") == 1, place)).alias("__last"))
    ends = ends.join(closing.select(F.col("source").alias("s"), F.struct("id", "hash").alias("__closing")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    ends = staged(ends.withColumnRenamed("source", "__s"), "mix-ends")
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("__row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["source"].alias("source"))
    own = _slim(packed, "doc_id", "text", "source", buckets, seed).select("__row", "__source", *[F.col(c).alias(c[2:]) for c in ("__key", "__id", "__hash")])
    joined = own.join(bounded_broadcast(ends, ends.count(), BROADCAST_ROWS), F.col("__source").eqNullSafe(F.col("__s")))
    more = F.coalesce(place <= F.col("__last"), F.lit(False)) | F.coalesce(F.struct("id", "hash").eqNullSafe(F.col("__closing")), F.lit(False))
    taken = joined.withColumn("__repeats", F.col("__epochs") + more.cast("long")).where("__repeats > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__repeats")))).select("__row.*")


def op2_mixing(spark, sf_dir):
    out = mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def mix_targets(spark, sf_dir):
    """What of the mix SQL can say: sizes and targets; the order of documents within a source is by hashes that only Spark has."""
    return mix(read(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


MIX_TARGETS_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
s as (select source, sum(size)::bigint n, [3.0::double, 1.0::double, 2.0::double][1 + (row_number() over (order by source nulls last) - 1) % 3] w from d group by 1),
o as (select *, 2.0::double * n cap, row_number() over (order by 2.0::double * n / w, source nulls last) k from s),
v as (select *, (1.5::double * sum(n) over () - coalesce(sum(cap) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) level from o window before as (order by k rows between unbounded preceding and 1 preceding)),
f as (select *, cap / w <= level filled from v), g as (select arg_min(level, k) filter (where not filled) final from f),
t as (select source s, n, case when filled then cap else least(cap, final * w) end target from f, g)
select doc_id, size, n source_size, round(target, 6) target from d join t on source is not distinct from s
"""
