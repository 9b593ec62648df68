"""Removal of repeated substrings with suffix arrays over content-defined shards.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
earlier: in a document of smaller id, or earlier in the same document.

1. Equal texts collapse to their smallest id; later copies go whole.
2. Each window of LENGTH bytes has an anchor, the 32-gram of the smallest hash in
   it, so equal windows have equal anchors. An anchor that occurs once in the
   corpus ends the search for its windows.
3. The windows of an anchor that occurs again are one string. Of equal strings
   of a document only the first leaves it; the others go, and are known to go at
   once. What leaves is sent to the shard of the anchor's hash, so equal windows
   meet in one shard.
4. A shard's strings are sorted by induced sorting (suffix_array), common
   prefixes are permuted to text order, and of each run of suffixes that agree in
   LENGTH bytes all but the earliest are marked.
5. Marked windows go back to their documents, whose bytes are cut.

Anchors that occur very often (a passage in a third of all documents, or one byte
many thousand times in a document) are cut into pieces of fewer windows, keyed by
what all of a piece's windows hold too, and equal pieces collapse before they are
sent. Strings of one key then differ in the few bytes by which a piece's windows
move, so no key has many of them: at most the anchor's occurrences below the second
limit, and above it what three bytes on either side can be.

Long documents are read in parts of CHUNK window starts, each with the LENGTH - 1
bytes that follow, so memory does not grow with a document.

Null texts are empty. Texts shorter than LENGTH lose nothing. A null id counts
as the smallest; rows that share id and text are one document with one result;
rows that share an id but not the text start at the same places, neither before
the other. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, read, slices, small_batches, staged, utf8
from .shingles import _INVERSE, _P, MASK, _powers, mix
from .suffix_array import permuted_lcp, suffix_array

LENGTH, GRAM = 100, 32
#: An anchor with so many occurrences is cut into pieces of so many windows.
PIECES = ((5_000, 4), (1_000, 16))
SHARD_BYTES = 700_000
#: Bytes of text that are hashed at once; some twenty arrays of eight bytes a byte live beside them.
SLICE_BYTES, CHUNK = 400_000, 400_000
FIRST = -(1 << 63)


class Hashes:
    """Hash of any part of a byte string, from prefix sums."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.append(np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), dtype=np.uint64))
        self.inverse = _powers(_INVERSE, n + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values (van Herk's blocks)."""
    n = len(x)
    blocks = -(-n // width) + 1
    full = np.full(blocks * width, np.uint64(MASK))
    full[:n] = x
    full = full.reshape(blocks, width)
    before = np.minimum.accumulate(full, axis=1).ravel()
    after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(data: bytes, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, first window, last window, anchor, hash of the anchor) of each run of windows with one anchor; and the hashes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    hashes = Hashes(raw)
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < length:
        return none, none, none, none, none.view(np.uint64), hashes
    at = np.arange(len(raw) - gram + 1)
    value = hashes.of(at, at + gram)
    # by the hash's upper half, then the leftmost
    keyed = (value & np.uint64(MASK ^ 0xFFFFFFFF)) | at.astype(np.uint64)
    anchor = (sliding_minimum(keyed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(bounds, start, side="right") - 1
    inside = start + length <= bounds[text + 1]
    start, anchor, text = start[inside], anchor[inside], text[inside]
    if not len(start):
        return none, none, none, none, none.view(np.uint64), hashes
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    last = np.append(first[1:], len(start)) - 1
    return text[first], start[first], start[last], anchor[first], value[anchor[first]], hashes


def parts(column, chunk: int | None = None):
    """(row, offset, data, bounds) of a text column: all of it, or a long text in parts whose window starts follow one another."""
    chunk = chunk or CHUNK
    data, bounds = utf8(column)
    if len(column) > 1 or len(data) <= chunk + LENGTH:
        yield np.arange(len(column)), 0, data, bounds
        return
    for at in range(0, max(1, len(data) - LENGTH + 1), chunk):
        own = data[at : at + chunk + LENGTH - 1]
        yield np.zeros(1, dtype=np.int64), at, own, np.array([0, len(own)])


def anchor_hashes(docs: DataFrame) -> DataFrame:
    """(id, hash, n) of (id, text): each distinct anchor of a document, or of a part of a long one, and how often it has it."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, chars=SLICE_BYTES):
            for row, _, data, bounds in parts(batch.column(1)):
                text, _, _, _, value, _ = anchors(data, bounds)
                order = np.lexsort((value, text))
                text, value = text[order], value[order]
                new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (value[1:] != value[:-1]))) if len(text) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(text)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[text[new]])), pa.array(value[new].view(np.int64)), pa.array(n.astype(np.int64))], names=["id", "hash", "n"]
                )

    return docs.mapInArrow(run, "id bigint, hash bigint, n bigint")


def united(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals (owner, begin, end) with those that touch or overlap made one, by owner and begin."""
    if not len(owner):
        return owner, begin, end
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order], begin[order], end[order]
    base = owner * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    new = np.append(True, (begin + base)[1:] > reach[:-1])
    new[1:] |= owner[1:] != owner[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], begin[first], reach[last] - base[first]


def window_strings(docs: DataFrame) -> DataFrame:
    """The strings to sort, of (id, t, text, found: array of (hash, piece)).

    (key, same, id, t, start, n, hot, string): windows of one content have one key;
    strings of one (key, same) are equal, and only the first in a slice has its bytes.
    Rows without a key are bytes [start, start + n) of a document to remove, whose
    windows stood earlier in it.
    """

    def run(batches):
        import pyarrow as pa

        def rows_of(batch, row, offset, data, bounds, wanted, piece, of_row):
            text, lo, hi, anchor, value, hashes = anchors(data, bounds)
            salt = mix(np.arange(batch.num_rows, dtype=np.uint64))
            keys = wanted.view(np.uint64) ^ salt[of_row]
            order = np.argsort(keys)
            probe = value ^ salt[row[text]]
            at = np.minimum(np.searchsorted(keys[order], probe), max(0, len(keys) - 1))
            hit = (keys[order][at] == probe) if len(keys) else np.zeros(len(probe), bool)
            size = np.where(hit, piece[order][at] if len(keys) else 0, 0)
            parts = []
            for width in np.unique(size[hit]).tolist():
                own = hit & (size == width)
                t, a, b, p, v = text[own], lo[own], hi[own], anchor[own], value[own]
                if not width:
                    parts.append((t, a, b, v, np.zeros(len(t), bool)))
                    continue
                low, high = (p - b) // width, (p - a) // width  # pieces by distance from the anchor, so the same for equal windows
                n = high - low + 1
                k = np.repeat(np.arange(len(t)), n)
                q = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                core = hashes.of(p[k] - q * width, p[k] - q * width - (width - 1) + LENGTH)
                key = mix(v[k] ^ mix(core + q.astype(np.uint64)))
                parts.append((t[k], np.maximum(a[k], p[k] - q * width - (width - 1)), np.minimum(b[k], p[k] - q * width), key, np.ones(len(k), bool)))
            if not parts:
                return None
            t, a, b, key, hot = (np.concatenate(x) for x in zip(*parts))
            same = hashes.of(a, b + LENGTH) ^ (b - a).astype(np.uint64)
            # in the order of the text, where neighbours overlap and so compress well
            order = np.argsort(a, kind="stable")
            t, a, b, key, hot, same = (x[order] for x in (t, a, b, key, hot, same))
            content = mix(key ^ mix(same))
            # of a document's equal strings the first stays
            ones = np.zeros(len(key), bool)
            ones[np.unique(mix(content ^ mix(t.astype(np.uint64))), return_index=True)[1]] = True
            gone = united(t[~ones], a[~ones], b[~ones] + LENGTH)
            t, a, b, key, hot, same, content = (x[ones] for x in (t, a, b, key, hot, same, content))
            new = np.zeros(len(key), bool)
            new[np.unique(content, return_index=True)[1]] = True
            strings = [data[x : y + LENGTH] if n else None for x, y, n in zip(a.tolist(), b.tolist(), new.tolist())]
            of = pa.array(row[np.append(t, gone[0])])
            start, n = np.append(a, gone[1]), np.append(b - a + 1, gone[2] - gone[1])
            without = np.append(np.zeros(len(t), bool), np.ones(len(gone[0]), bool))
            pad = np.zeros(len(gone[0]), np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(key.view(np.int64), pad), mask=without), pa.array(np.append(same.view(np.int64), pad), mask=without),
                    batch.column(0).take(of), batch.column(1).take(of), pa.array(start - bounds[np.append(t, gone[0])] + offset), pa.array(n),
                    pa.array(np.append(hot, pad.astype(bool)), mask=without), pa.array([*strings, *[None] * len(gone[0])], pa.binary()),
                ],
                names=["key", "same", "id", "t", "start", "n", "hot", "string"],
            )

        for batch in slices(batches, chars=SLICE_BYTES, column=2):
            found = batch.column(3)
            of_row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            wanted, piece = (found.flatten().field(k).to_numpy() for k in (0, 1))
            for row, offset, data, bounds in parts(batch.column(2)):
                out = rows_of(batch, row, offset, data, bounds, wanted, piece, of_row)
                if out is not None:
                    yield out

    return docs.mapInArrow(run, "key bigint, same bigint, id bigint, t bigint, start bigint, n bigint, hot boolean, string binary")


def marked(strings: DataFrame) -> DataFrame:
    """(id, t, start, end) of bytes to remove, from strings that are dealt and sorted by key."""

    def shard(rows: list[dict]) -> tuple:
        key, same, ids, t, start, n = (np.concatenate([r[c] for r in rows]) for c in ("key", "same", "id", "t", "start", "n"))
        bytes_of = [s for r in rows for s in r["string"]]
        order = np.lexsort((start, ids, same, key))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (same[order][1:] != same[order][:-1]))
        group = np.cumsum(new) - 1
        head = order[new]
        # copies of a string that are not its first occurrence go whole
        later = np.zeros(len(key), bool)
        later[order] = (ids[order] != ids[head][group]) | (start[order] != start[head][group])
        text_of = [None] * len(head)
        for k, g in zip(order.tolist(), group.tolist()):
            if bytes_of[k] is not None:
                text_of[g] = bytes_of[k]
        keep = np.argsort(key[head], kind="stable")  # neighbours of one key
        head, text_of = head[keep], [text_of[k] for k in keep.tolist()]
        lengths = np.array([len(x) for x in text_of])
        begin = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(text_of), dtype=np.uint8)
        sa = suffix_array(text, LENGTH)
        lcp = permuted_lcp(text, sa, begin)
        run = np.cumsum(lcp[sa] < LENGTH)
        owner = np.repeat(np.arange(len(head)), lengths)
        offset = np.arange(len(text)) - begin[owner]
        valid = offset[sa] < n[head][owner[sa]]
        at, run = sa[valid], run[valid]
        place = np.empty(len(head), dtype=np.int64)
        by_place = np.lexsort((start[head], ids[head]))
        place[by_place] = np.append(0, np.cumsum((ids[head][by_place][1:] != ids[head][by_place][:-1]) | (start[head][by_place][1:] != start[head][by_place][:-1])))
        rank = place[owner[at]] * (int(lengths.max()) + 1) + offset[at]
        heads = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(run))))
        gone = np.sort(at[rank > least])
        cut = np.append(True, (np.diff(gone) != 1) | (owner[gone][1:] != owner[gone][:-1])) if len(gone) else np.zeros(0, bool)
        first = gone[cut]
        last = gone[np.append(np.flatnonzero(cut)[1:], len(gone)) - 1] if len(gone) else gone
        row = head[owner[first]]
        a = np.append(start[row] + offset[first], start[later])
        b = np.append(start[row] + offset[last] + LENGTH, start[later] + n[later] - 1 + LENGTH)
        row = np.append(row, np.flatnonzero(later))
        return ids[row], t[row], a, b

    def run(batches):
        import pyarrow as pa

        names = ["id", "t", "start", "end"]
        held, size, last = [], 0, None
        for batch in batches:
            key = batch.column(0).to_numpy()
            strings = batch.column(7).to_pylist()
            columns = {c: batch.column(k).to_numpy() for c, k in (("key", 0), ("same", 1), ("id", 2), ("t", 3), ("start", 4), ("n", 5))}
            edges = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))  # ends of runs of one key
            upto = np.cumsum([len(s) + 16 if s is not None else 16 for s in strings])[edges - 1]
            if held and size >= SHARD_BYTES and key[0] != last:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in shard(held)], names=names)
                held, size = [], 0
            begin, done, last = 0, 0, key[-1]
            while begin < len(key):
                k = min(int(np.searchsorted(upto, done + SHARD_BYTES - size)), len(edges) - 1)
                end = int(edges[k])
                held.append({c: v[begin:end] for c, v in columns.items()} | {"string": strings[begin:end]})
                size += int(upto[k]) - done
                begin, done = end, int(upto[k])
                if size >= SHARD_BYTES and end < len(key):  # a shard ends where a key does
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in shard(held)], names=names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in shard(held)], names=names)

    return strings.select("key", "same", "id", "t", "start", "n", "hot", "string").mapInArrow(run, "id bigint, t bigint, start bigint, end bigint")


def cut_texts(docs: DataFrame) -> DataFrame:
    """(id, t, n_removed, n_spans, kept, kept_sha256) of (id, t, text, spans: array of (start, end))."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, column=2):
            out = {"n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
            data, bounds = utf8(batch.column(2))
            for k, spans in enumerate(batch.column(3).to_pylist()):
                own = data[bounds[k] : bounds[k + 1]]
                merged: list[list[int]] = []
                for a, b in sorted((s["start"], s["end"]) for s in spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                ends = [0, *(b for _, b in merged)]
                kept = b"".join(own[x:y] for x, y in zip(ends, [*(a for a, _ in merged), len(own)]))
                out["n_removed"].append(len(own) - len(kept))
                out["n_spans"].append(len(merged))
                out["kept"].append(kept)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept"], pa.binary()), pa.array(out["kept_sha256"])],
                names=["id", "t", *out],
            )

    return docs.mapInArrow(run, "id bigint, t bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, spans): rows (id, t, n_bytes, sha, copy), texts (id, t, text) of docs, and (id, t, spans), the spans an array of (start, end) to remove.

    Rows with copy are copies of a text of smaller id; they have no spans but go whole if long enough.
    """
    with small_batches(docs.sparkSession):
        return _removed_spans(docs, id_col, text_col)


def _removed_spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(FIRST)).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    slim = staged(plain.select("id", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "texts")
    # written, so that the join deals both sides and Spark can split a large group of copies
    firsts = staged(slim.groupBy("t", "sha").agg(F.min("id").alias("rep")), "firsts")
    rows = staged(slim.join(firsts, ["t", "sha"]).withColumn("copy", F.col("id") > F.col("rep")).drop("rep"), "rows")
    discard(slim)
    discard(firsts)
    copies = rows.where("copy").select("id", "t").distinct()
    own = staged(anchor_hashes(plain.select("id", "text")), "anchors")
    # a copy's anchors are its first text's; a document that is but a copy is not counted
    whole = staged(copies.join(rows.where("not copy").select("id").distinct(), "id", "left_anti").select("id").distinct(), "copied")
    counted = own.join(whole, "id", "left_anti")
    again = counted.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    piece = F.lit(0)
    for least, width in reversed(PIECES):
        piece = F.when(F.col("n") >= least, F.lit(width)).otherwise(piece)
    found = counted.select("id", "hash").join(again.select("hash", piece.alias("piece")), "hash")
    found = staged(found.groupBy("id").agg(F.collect_list(F.struct("hash", "piece")).alias("found")), "found")
    discard(own)
    firsts_only = plain.join(found, "id").join(copies, ["id", "t"], "left_anti")
    strings = staged(window_strings(firsts_only.select("id", "t", "text", "found")), "strings")
    discard(found)
    discard(whole)
    hot = strings.where("hot")
    heads = hot.groupBy("key", "same").agg(F.min(F.struct("id", "start", "t")).alias("head"), F.max("n").alias("n"), F.max("string").alias("string"))
    heads = staged(heads.select("key", "same", "head.id", "head.t", "head.start", "n", F.lit(True).alias("hot"), "string"), "heads")
    dealt = strings.where("not hot").unionByName(heads).repartition("key").sortWithinPartitions("key")
    spans = staged(marked(dealt), "marked")
    # of a frequent string every place but the head goes; rows that share the head's id and place stand where it does
    head = F.max("head").over(W.partitionBy("id", "start", "key", "same"))
    places = hot.select("id", "t", "start", "n", "key", "same", F.lit(0).alias("head"))
    places = places.unionByName(heads.select("id", "t", "start", "n", "key", "same", F.lit(1).alias("head"))).withColumn("first", head).where("first = 0")
    later = places.select("id", "t", "start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("end"))
    own = strings.where("key is null").select("id", "t", "start", (F.col("start") + F.col("n")).alias("end"))
    spans = spans.unionByName(later).unionByName(own).groupBy("id", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return rows, plain, spans


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, texts, spans = removed_spans(docs, id_col, text_col)
    # rows that share id and text are cut once
    cut = cut_texts(texts.join(spans, ["id", "t"]).select("id", "t", "text", "spans")).drop("kept")
    cut = cut.groupBy("id", "t").agg(*[F.max(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256")])
    out = rows.join(cut, ["id", "t"], "left")
    gone = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    return out.select(
        F.when(F.col("id") != FIRST, F.col("id")).alias(id_col),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op1_substring_dedup(spark, sf_dir):
    return deduplicated(read(spark, sf_dir, "documents", "doc_id", "text"))


#: Windows are compared by a hash of their hex digits; texts go in blocks of 1000 window starts.
OP1_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
l as (select doc_id, h, (length(h) / 2)::bigint n from d),
b as (select doc_id, j, h[2000 * j + 1 : 2000 * j + 2198] s, least(1000, n - 99 - 1000 * j) m from (select doc_id, h, n, unnest(range((n - 99 + 999) // 1000)) j from l where n >= 100)),
w as (select doc_id, 1000 * j + k k, hash(s[2 * k + 1 : 2 * k + 200]) g from (select doc_id, j, s, unnest(range(m)) k from b)),
f as (select g, min(row(doc_id, k)) first from w group by 1 having count(*) > 1),
x as (select doc_id, k from w join f using (g) where row(doc_id, k) > first),
i as (select doc_id, k, sum(new) over (partition by doc_id order by k) run from (select doc_id, k, case when k <= lag(k) over (partition by doc_id order by k) + 100 then 0 else 1 end new from x)),
s as (select doc_id, min(k) a, max(k) + 100 b from i group by doc_id, run),
t as (select doc_id, a, coalesce(lag(b) over (partition by doc_id order by a), 0) before, b from s),
p as (select t.doc_id, sum(b - a)::bigint n_removed, count(*)::bigint n_spans, string_agg(h[2 * before + 1 : 2 * a], '' order by a) || h[2 * max(b) + 1 :] kept from t join l using (doc_id) group by t.doc_id, h)
select doc_id, n n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256 from l left join p using (doc_id)
"""
