"""License scans: ordered signature rules behind a keyword gate.

Signatures are regexes over lower-cased bytes: wording of licenses, written by
hand (license_texts), and the identifiers and names of a table of licenses. One
pass over a block of texts finds the keywords, of which every signature has one
that it cannot do without; a signature meets only the texts with its own.
Overlapping detections are resolved by priority: a detection that lies within
one of a smaller priority number, or of the same and earlier in the table, is
dropped; base phrases are always reported.

Words are runs of letters, digits and characters beyond ASCII; counting them
takes one pass over the bytes of a block. Null texts are empty (no words, no
labels, score 0). Rows are judged one by one, so repeated rows get equal results; an
empty table gives an empty result. Only id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, slices, utf8
from .license_texts import TEXTS

#: Base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: SPDX identifiers and the names that texts use; versions are matched apart.
LICENSES = (
    ("agpl-3.0", "gnu affero general public license"),
    ("lgpl-2.1", "gnu lesser general public license"),
    ("lgpl-2.0", "gnu library general public license"),
    ("gfdl-1.3", "gnu free documentation license"),
    ("gpl-2.0", "gnu general public license"),
    ("apache-2.0", "apache license"),
    ("apache-1.1", "apache software license"),
    ("mit", "mit license"),
    ("mit-0", "mit no attribution license"),
    ("bsd-2-clause", "simplified bsd license"),
    ("bsd-3-clause", "new bsd license"),
    ("bsd-3-clause", "modified bsd license"),
    ("bsd-4-clause", "original bsd license"),
    ("bsd", "bsd license"),
    ("isc", "isc license"),
    ("mpl-2.0", "mozilla public license"),
    ("epl-2.0", "eclipse public license"),
    ("cddl-1.0", "common development and distribution license"),
    ("cpl-1.0", "common public license"),
    ("eupl-1.2", "european union public licence"),
    ("artistic-2.0", "artistic license"),
    ("zlib", "zlib license"),
    ("bsl-1.0", "boost software license"),
    ("unlicense", "the unlicense"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("cc0-1.0", "creative commons zero"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial"),
    ("cc-by-nd-4.0", "creative commons attribution noderivatives"),
    ("cc-by-4.0", "creative commons attribution"),
    ("ofl-1.1", "sil open font license"),
    ("psf-2.0", "python software foundation license"),
    ("python-2.0", "python license"),
    ("php-3.01", "php license"),
    ("ruby", "ruby license"),
    ("vim", "vim license"),
    ("postgresql", "postgresql license"),
    ("openssl", "openssl license"),
    ("ncsa", "university of illinois ncsa open source license"),
    ("ms-pl", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal license"),
    ("osl-3.0", "open software license"),
    ("afl-3.0", "academic free license"),
    ("ecl-2.0", "educational community license"),
    ("lppl-1.3c", "latex project public license"),
    ("odbl-1.0", "open database license"),
    ("pddl-1.0", "public domain dedication and license"),
    ("upl-1.0", "universal permissive license"),
    ("beerware", "beerware license"),
    ("x11", "x11 license"),
    ("w3c", "w3c software license"),
    ("sleepycat", "sleepycat license"),
    ("qpl-1.0", "q public license"),
    ("sspl-1.0", "server side public license"),
    ("busl-1.1", "business source license"),
    ("elastic-2.0", "elastic license"),
    ("mulanpsl-2.0", "mulan permissive software license"),
    ("ipl-1.0", "ibm public license"),
    ("spl-1.0", "sun public license"),
    ("npl-1.1", "netscape public license"),
)

#: Ways of naming a license: priority, score, and how the regex is made from the identifier and the name.
FORMS = (
    (0, 1.00, lambda i, n: rb"spdx license identifier " + i + rb"(?: only| or later)?"),
    (3, 0.80, lambda i, n: n + rb"(?: (?:v|ver|version) ?[0-9]+(?: [0-9]+)*)?"),
)
BASE_SCORE = 0.6

WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
LEFT, RIGHT = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"


def signature(words: bytes) -> re.Pattern:
    """A regex over lower-cased bytes; each blank stands for what separates words."""
    return re.compile(LEFT + b"(?:" + words.replace(b" ?", b"(?:" + GAP + b")?").replace(b" ", GAP) + b")" + RIGHT, re.DOTALL)


def keywords(words: bytes) -> tuple[bytes, ...]:
    """The longest literal of each alternative of a signature: a text that matches holds one of them."""
    plain = words
    while (less := re.sub(rb"\(\?:[^()]*\)\??", b" ", plain)) != plain:
        plain = less
    plain = re.sub(rb"\[[^\]]*\](?:[*+?]|\{[^}]*\})?|\.\{[^}]*\}|[a-z0-9]\?", b" ", plain.replace(b" ?", b" "))
    return tuple(max(re.findall(rb"[a-z0-9]+", x), key=len) for x in plain.split(b"|"))


def signatures() -> list[tuple[int, float, str, re.Pattern, tuple[bytes, ...]]]:
    """All rules in the order in which they are applied: priority, score, label, regex, keywords."""
    rules = [(p, s, label, make(re.sub(rb"[^a-z0-9]+", b" ", label.encode()), name.encode())) for label, name in LICENSES for p, s, make in FORMS]
    rules += [(p, s, label, words) for label, p, s, words in TEXTS]
    return [(p, s, label, signature(words), keywords(words)) for p, s, label, words in sorted(rules, key=lambda r: r[0])]


class Covered:
    """Intervals that were kept, by where they begin, with how far those up to each reach."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.begins: list[int] = []
        self.reach: list[int] = []

    def holds(self, begin: int, end: int) -> bool:
        at = bisect_right(self.begins, begin) - 1
        return at >= 0 and self.reach[at] >= end

    def add(self, spans: list[tuple[int, int]]) -> None:
        self.spans = sorted(self.spans + spans)
        self.begins = [a for a, _ in self.spans]
        self.reach = np.maximum.accumulate([b for _, b in self.spans]).tolist()


def detect(text: bytes, rules, base) -> tuple[list, list]:
    """(base places as (start, label), detections as (start, end, label, score)) of lower-cased bytes."""
    places = [(m.start(), label) for label, regex in base for m in regex.finditer(text)]
    kept: list[tuple[int, int, str, float]] = []
    covered = Covered()
    for _, score, label, regex, _ in rules:
        # detections of one rule do not overlap
        new = [m.span() for m in regex.finditer(text) if not covered.holds(*m.span())]
        if new:
            covered.add(new)
            kept += [(a, b, label, score) for a, b in new]
    return places, kept


def gate(words: list[bytes]):
    """An automaton that finds the places of words, by number, in a text read as Latin-1."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, w in enumerate(words):
        out.add_word(w.decode(), k)
    out.make_automaton()
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, and detections with byte spans."""

    def run(batches):
        import pyarrow as pa

        rules = signatures()
        base = [(label, signature(words.encode()), keywords(words.encode())) for words, label in PHRASES]
        words = sorted({k for r in rules for k in r[-1]} | {k for b in base for k in b[-1]})
        number = {w: k for k, w in enumerate(words)}
        rules_of, base_of = ([frozenset(number[k] for k in r[-1]) for r in x] for x in (rules, base))
        found_by = gate(words)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))
        for batch in slices(batches):
            data, bounds = utf8(batch.column(1))
            data = data.lower()
            is_word = WORD[np.frombuffer(data, dtype=np.uint8)]
            starts = is_word.copy()
            starts[1:] &= ~is_word[:-1]
            cuts = bounds[:-1][bounds[:-1] < bounds[1:]]
            starts[cuts] = is_word[cuts]
            first = np.flatnonzero(starts)
            at = np.searchsorted(first, bounds)
            n = batch.num_rows
            n_base, lo, hi, base_labels, labels, score, found = [0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n, [[]] * n
            # a word that straddles two texts is counted to the second, which costs a look
            hits = np.array(list(found_by.iter(data.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
            hits = np.unique((np.searchsorted(bounds, hits[:, 0], side="right") - 1) * len(words) + hits[:, 1])
            owner, word = np.divmod(hits, len(words))
            cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
            for i, own in zip(owner[cut].tolist(), np.split(word, cut[1:])):
                have = set(own.tolist())
                some = [r for r, need in zip(rules, rules_of) if not need.isdisjoint(have)]
                places, kept = detect(data[bounds[i] : bounds[i + 1]], some, [b[:2] for b, need in zip(base, base_of) if not need.isdisjoint(have)])
                if places:
                    where = np.searchsorted(first, bounds[i] + np.array([p for p, _ in places])) - at[i]
                    n_base[i], lo[i], hi[i] = len(places), int(where.min()), int(where.max())
                own = {x for _, x in places}
                base_labels[i] = ",".join(sorted(own))
                labels[i] = ",".join(sorted(own | {x for _, _, x, _ in kept}))
                score[i] = max([0.0, *([BASE_SCORE] if places else []), *(s for _, _, _, s in kept)])
                found[i] = [{"start": a, "end": b, "label": x, "score": s} for a, b, x, s in sorted(kept)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(n_base, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()),
                    pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(found, span),
                ],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = (
        f"id {plain.schema[0].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, detections array<struct<start:bigint,end:bigint,label:string,score:double>>"
    )
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_licenses(spark, sf_dir):
    return scan(read(spark, sf_dir, "documents", "doc_id", "text")).drop("detections")


def license_places(spark, sf_dir):
    """What of the scan SQL can say: words and base phrases."""
    return op6_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _places_sql() -> str:
    found = " union all ".join(
        f"select doc_id, '{label}' label, i - 1 place from (select doc_id, w, unnest(range(1, len(w) + 1)) i from d) where w[i : i + {len(p.split()) - 1}] = {p.split()}" for p, label in PHRASES
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents), p as ({found})
select d.doc_id, len(w)::bigint n_words, count(place)::bigint n_base, min(place)::bigint first_word, max(place)::bigint last_word, coalesce(string_agg(distinct label, ',' order by label), '') base_labels
from d left join p using (doc_id) group by d.doc_id, w
"""


LICENSE_PLACES_SQL = _places_sql()
