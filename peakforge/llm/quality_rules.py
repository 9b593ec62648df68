"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression over the text, and the table of limits
becomes one boolean expression; no user functions run. Null and empty texts
have no words and are rejected by the length rule; every row is judged on its
own, so repeated rows get equal verdicts and an empty table gives an empty one.
Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read

#: Common words of the four languages that running text has.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he this are or an at from which "
    "der die das und ist in zu den mit von des ein eine auf im für sich nicht auch "
    "le la les de et des un une du en que qui est dans pour pas par sur au avec "
    "el la los las de y que en un una por con para no se su es del lo"
).split()


@dataclass(frozen=True)
class Limit:
    """A measure and the closed range in which a document is kept."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are to words, characters or lines as named.
LIMITS = (
    Limit("words", "n_words", low=50),
    Limit("repeated windows", "repeat_ratio", high=0.5),
    Limit("symbols", "symbol_ratio", high=0.1),
    Limit("word length", "mean_word_chars", low=2.5, high=12.0),
    Limit("upper case", "upper_ratio", high=0.3),
    Limit("exclamations", "bang_ratio", high=0.3),
    Limit("repeated lines", "dup_line_ratio", high=0.5),
    Limit("stop words", "stop_ratio", low=0.01),
)


#: Up to so many distinct repeated windows they are looked up one by one; beyond, by a sort.
FEW = 64


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three that the text has twice or more.

    Windows are compared by a 64-bit hash of their three words.
    """

    def windows(w: Column) -> Column:
        return F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
        ).otherwise(F.array().cast("array<bigint>"))

    def same(s: Column, x: Column, j: Column, name: str) -> Column:
        return F.coalesce(x[name] == F.get(s, j - 1)[name], F.lit(False)) | F.coalesce(x[name] == F.get(s, j + 1)[name], F.lit(False))

    def places(t: Column, twice: Column) -> Column:
        few = F.filter(F.transform(t, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
        ordered = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("t"), i.alias("i"))))
        many = let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, x, j, "t")), lambda x: x["i"])))
        return F.when(F.size(twice) <= FEW, few).otherwise(many)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeats(t: Column) -> Column:
        return let(F.sort_array(t), lambda s: F.array_distinct(F.filter(s, lambda x, j: F.coalesce(x == F.get(s, j - 1), F.lit(False)))))

    def count(t: Column) -> Column:
        return let(repeats(t), lambda twice: F.when(F.size(twice) == 0, F.lit(0)).otherwise(let(places(t, twice), covered)))

    return let(words, lambda w: let(windows(w), count))


def measures(docs: DataFrame, text_col: str = "text", *keep: str, more: bool = False) -> DataFrame:
    """The columns ``keep`` and all measures of the text, in one projection over the scan.

    more: also those that no rule of the table needs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines = F.col("__w"), F.col("__l")
    base = docs.select(
        *keep,
        text.alias("__t"),
        let(
            split_words(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
                *([F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words")] if more else []),
            ),
        ).alias("__w"),
        let(
            F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        ).alias("__l"),
    )
    t = F.col("__t")
    of_words = ["n_words", "word_chars", "n_repeat_words", "n_stop_words", *(["n_distinct_words"] if more else [])]
    counts = {"n_symbols": r"[#*$%&|<>]", "n_bangs": "!", "n_upper": r"\p{Lu}"} | ({"n_digits": "[0-9]"} if more else {})
    counted = base.select(
        *keep,
        *[words[c].alias(c) for c in of_words],
        *[lines[c].alias(c) for c in ("n_lines", "n_dup_lines")],
        *[F.regexp_count(t, F.lit(p)).cast("long").alias(c) for c, p in counts.items()],
    )

    def ratio(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return counted.withColumns(
        {
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
            "symbol_ratio": ratio("n_symbols", "n_words"),
            "mean_word_chars": ratio("word_chars", "n_words"),
            "upper_ratio": ratio("n_upper", "word_chars"),
            "bang_ratio": ratio("n_bangs", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "stop_ratio": ratio("n_stop_words", "n_words"),
        }
        | ({"distinct_ratio": ratio("n_distinct_words", "n_words"), "digit_ratio": ratio("n_digits", "word_chars"), "line_words": ratio("n_words", "n_lines")} if more else {})
    )


def verdict(limits: tuple[Limit, ...] = LIMITS) -> Column:
    """The table of limits as one boolean expression over the measures."""
    ok = F.lit(True)
    for x in limits:
        if x.low is not None:
            ok = ok & (F.col(x.measure) >= x.low)
        if x.high is not None:
            ok = ok & (F.col(x.measure) <= x.high)
    return ok


def failed_rules(limits: tuple[Limit, ...] = LIMITS) -> Column:
    """Names of the rules that a document breaks, comma-joined."""
    parts = []
    for x in limits:
        bad = F.lit(False)
        if x.low is not None:
            bad = bad | (F.col(x.measure) < x.low)
        if x.high is not None:
            bad = bad | (F.col(x.measure) > x.high)
        parts.append(F.when(bad, F.lit(x.name)))
    return F.concat_ws(",", *parts)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: tuple[Limit, ...] = LIMITS) -> DataFrame:
    """One row a document: its id, measures, base_failed, kept and the rules it breaks."""
    m = measures(docs.withColumnRenamed(id_col, "__id").select("__id", F.col(text_col).alias("__text")), "__text", "__id")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = m.withColumn("base_failed", base).withColumn("kept", ~base & verdict(limits)).withColumn("failed", failed_rules(limits))
    return out.withColumnRenamed("__id", id_col)


def kept_documents(docs: DataFrame, limits: tuple[Limit, ...] = LIMITS) -> DataFrame:
    """The documents, all their columns as they were, without those that the rules reject."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    m = measures(docs.select(row, docs["text"].alias("__text")), "__text", "__row")
    return m.where(verdict(limits)).select("__row.*")


def op7_quality_rules(spark, sf_dir):
    out = judge(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w)),
r as (select doc_id, count(distinct i + j) n from (select doc_id, i, count(*) over (partition by doc_id, g) c from g), (values (0), (1), (2)) t(j) where c > 1 group by 1),
m as (
  select w.doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(r.n, 0) n_repeat_words,
    len(ls) n_lines, len(regexp_extract_all(t, '!')) n_bangs, len(regexp_extract_all(t, '\p{{Lu}}')) n_upper, len(list_filter(ws, lambda x: lower(x) in ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) n_stop
  from w left join r on r.doc_id = w.doc_id),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, greatest(n_words, 1) one from m)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed,
  not base_failed and n_symbols / one <= 0.1 and word_chars / one between 2.5 and 12 and n_upper / greatest(word_chars, 1) <= 0.3 and n_bangs / one <= 0.3
    and n_dup_lines / greatest(n_lines, 1) <= 0.5 and n_stop / one >= 0.01 kept
from v
"""
