"""Secret scans with a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: texts that
match must contain them. A block of documents is indexed by the trigrams that
any query names, in one pass over its bytes, postings are intersected and united
as the query says, and only the candidates are scanned. A rule without mandatory trigrams scans all.

Trigrams are compared in lower case, which can only add candidates. Null texts
are empty; empty texts have no spans; rows are judged one by one, so repeated
rows get equal results; an empty table gives an empty one. Only id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, slices, utf8

ALL = ("all",)
FEW_STRINGS, FEW_CHARS = 96, 8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 1
    base: bool = False


#: The rules, base kinds first; spans that start together are listed in this order. A match counts if the group has the least length.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 16, True),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9a-zA-Z]{24,}"),
    Rule("url_password", r"[a-z]{3,10}://[^/\s:@]{1,64}:[^/\s:@]{3,64}@"),
)


def _and(parts: list) -> tuple:
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> tuple:
    """Some string of the set occurs: all of its trigrams do."""
    return _or([_and([("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(op, arg) -> set[str] | None:
    """All strings that the node matches, in lower case, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "AT":
        return {""}
    if name == "IN":
        found: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                found.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < FEW_CHARS:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= FEW_CHARS else None
    if name == "SUBPATTERN":
        return _sequence_strings(arg[-1])
    if name == "BRANCH":
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] != _parser.MAXREPEAT and arg[1] <= 3:
        one = _sequence_strings(arg[2])
        if one is None:
            return None
        found, power = set(), {""}
        for k in range(arg[1] + 1):
            if k >= arg[0]:
                found |= power
            power = {a + b for a in power for b in one}
            if len(power) > FEW_STRINGS:
                return None
        return found
    return None


def _sequence_strings(seq) -> set[str] | None:
    out = {""}
    for op, arg in seq:
        s = _strings(op, arg)
        if s is None or len(out) * len(s) > FEW_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def _query(seq) -> tuple:
    parts, exact = [], {""}
    for op, arg in seq:
        s = _strings(op, arg)
        if s is not None and len(exact) * len(s) <= FEW_STRINGS:
            exact = {a + b for a in exact for b in s}
            continue
        parts.append(_of_strings(exact))
        exact = {""}
        name = str(op)
        if s is not None:
            exact = s
        elif name == "SUBPATTERN":
            parts.append(_query(arg[-1]))
        elif name == "BRANCH":
            parts.append(_or([_query(x) for x in arg[1]]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            parts.append(_query(arg[2]))
    return _and([*parts, _of_strings(exact)])


def trigram_query(pattern: str, flags: int = 0) -> tuple:
    """The Boolean query: ("all",), ("gram", g), ("and", ...) or ("or", ...)."""
    return _query(_parser.parse(pattern, flags))


def grams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "gram" else set().union(*map(grams_of, query[1:])) if query != ALL else set()


def candidates(query: tuple, postings: dict[str, set[int]], everything: range) -> set[int] | range:
    if query == ALL:
        return everything
    if query[0] == "gram":
        return postings[query[1]]
    sets = [set(candidates(x, postings, everything)) for x in query[1:]]
    return set.intersection(*sets) if query[0] == "and" else set.union(*sets)


class TrigramIndex:
    """Which texts of a block hold which of some trigrams, in lower case, from one pass over the block's bytes."""

    def __init__(self, grams: list[str]):
        # a trigram beyond ASCII tells nothing here: all texts are taken to hold it
        self.grams = sorted(g for g in grams if g.isascii())
        self.open = [g for g in grams if not g.isascii()]
        self.codes = np.array([int.from_bytes(g.encode(), "big") for g in self.grams], dtype=np.uint32)
        self.begins = np.zeros(1 << 16, dtype=bool)
        self.begins[self.codes >> 8] = True

    def postings(self, data: bytes, bounds: np.ndarray) -> dict[str, set[int]]:
        out: dict[str, set[int]] = {g: set() for g in self.grams} | {g: set(range(len(bounds) - 1)) for g in self.open}
        raw = np.frombuffer(data.lower(), dtype=np.uint8)
        if len(raw) < 3 or not len(self.codes):
            return out
        pair = raw[:-2].astype(np.uint16) << 8 | raw[1:-1]
        at = np.flatnonzero(self.begins[pair])
        code = pair[at].astype(np.uint32) << 8 | raw[at + 2]
        which = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        owner = np.searchsorted(bounds, at, side="right") - 1
        found = (self.codes[which] == code) & (at + 3 <= bounds[owner + 1])
        for k, i in np.unique(np.column_stack([which[found], owner[found]]), axis=0).tolist():
            out[self.grams[k]].add(i)
        return out


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: its id and an array of (kind, start, end, base), in code points, by start and then the rules' order."""

    def scan(batches):
        import pyarrow as pa

        compiled = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]
        index = TrigramIndex(sorted(set().union(*[grams_of(q) for _, _, q in compiled])))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            postings, found = index.postings(*utf8(batch.column(1))), [[] for _ in texts]
            for k, (rule, regex, query) in enumerate(compiled):
                for i in candidates(query, postings, range(len(texts))):
                    for m in regex.finditer(texts[i]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[i].append((m.start(), k, m.end()))
            rows = [[{"kind": rules[k].kind, "start": a, "end": b, "base": rules[k].base} for a, k, b in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=kind)], names=["id", "spans"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {plain.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return plain.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def digest(base: list[str]) -> str:
    return hashlib.sha256(",".join(base).encode()).hexdigest()


def op5_secrets(spark, sf_dir):
    out = spans(read(spark, sf_dir, "documents", "doc_id", "text"))

    def shown(only_base: bool):
        chosen = F.filter("spans", lambda x: x["base"]) if only_base else F.col("spans")
        return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(shown(True).cast("binary"), 256).alias("base_sha256"), shown(False).alias("spans"))


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The spans from what stands between matches: a match begins where all before it, matched or not, ends."""

    def either(x: str) -> str:
        return re.sub(r"(?<!\\)[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", x)

    parts = []
    for k, r in enumerate(rules):
        # the words of a rule in either case; its other characters stand in classes of their own
        words, rest = r.pattern.split(")", 1) if r.flags & re.IGNORECASE else ("", r.pattern)
        p = ((either(words) + ")" if words else "") + rest).replace("'", "''")
        parts.append(f"select doc_id, {k} k, '{r.kind}' kind, {r.least} least, regexp_extract_all(t, '{p}') m, regexp_extract_all(t, '{p}', {r.group}) v, string_split_regex(t, '{p}') s from d")
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents), r as ({" union all ".join(parts)}),
e as (select doc_id, k, kind, least, unnest(range(1, len(m) + 1)) i, m, v, s from r),
f as (select doc_id, k, kind, list_sum(list_transform(s[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) a, length(m[i]) n from e where length(v[i]) >= least),
g as (select doc_id, kind, k, a, kind || ':' || a::bigint || ':' || (a + n)::bigint x from f)
select doc_id, count(*) filter (where kind = 'assign')::bigint n_assign, count(*) filter (where kind = 'access')::bigint n_access, count(*) filter (where kind = 'hex')::bigint n_hex,
  sha256(coalesce(string_agg(x, ',' order by a, k) filter (where k < {sum(r.base for r in rules)}), '')) base_sha256, coalesce(string_agg(x, ',' order by a, k), '') spans from d left join g using (doc_id) group by doc_id
"""


OP5_SQL = _sql()
