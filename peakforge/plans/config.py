"""Settings of an archive and of a search."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

#: Fixed values of the data model.
MAX_PEAKS = 50
MAX_MZ = 2000.0
BINS = 65535
MAX_SCORE = 42925
DUMMY_MZ = 0.5
PROTON = 1.007276
ISOTOPE = 1.0032
VECTOR_BINS = 4003
VECTOR_WIDTH = 0.5
#: Vectors are filled up to a number of dimensions that the indexes' subspaces divide.
VECTOR_DIMS = 4096
MAX_TOPN = 1000
NO_MODEL = 10000.0


@dataclass(frozen=True)
class ArchiveConfig:
    """How spectra are encoded and indexed; the defaults are those of a new archive."""

    index_strings: tuple[str, ...] = ("IVF256,PQ16", "IVF256,PQ16")
    seeds: tuple[int, ...] = (1, 2)
    tolerance: int = 15
    min_peaks: int = 6
    remove_precursor: bool = True
    flanking_bins: bool = True
    training_spectra: int = 100_000
    seed: int = 42


@dataclass(frozen=True)
class SearchConfig:
    topn: int = 10
    batch: int = 2000
    nprobe: int = 8
    candidates: int = 1024
    true_topk: int = 10
    true_min_peaks: int = 10
    true_min_dp: float = 0.6
    neighbor_min_dp: float = 0.5
    background_fraction: float = 0.01
    background_most: int = 10_000
    background_least: int = 5_000
    pvalue_seeds: tuple[int, ...] = (42,)
    top_hit_only: bool = True

    def __post_init__(self):
        if not 1 <= self.topn <= MAX_TOPN:
            raise ValueError(f"topn must be in 1..{MAX_TOPN}")


@dataclass(frozen=True)
class IndexSpec:
    lists: int
    subspaces: int
    bits: int = 8


def parse_index(text: str) -> IndexSpec:
    """``IVFk,PQm`` (or ``IVFk,PQmxb``)."""
    m = re.fullmatch(r"\s*IVF(\d+),PQ(\d+)(?:x(\d+))?\s*", text)
    if not m:
        raise ValueError(f"not an index string: {text!r}")
    return IndexSpec(int(m[1]), int(m[2]), int(m[3] or 8))


def parse_indexes(strings: str, seeds: str = "default") -> list[tuple[IndexSpec, int]]:
    """``;``-separated index strings, and ``default`` or ``customized:a;b`` seeds."""
    specs = [parse_index(x) for x in strings.split(";") if x.strip()]
    kind, _, own = seeds.partition(":")
    numbers = list(range(len(specs))) if kind == "default" else [int(x) for x in own.split(";") if x.strip()]
    if len(numbers) != len(specs):
        raise ValueError("one seed an index is needed")
    return list(zip(specs, numbers))


def valid_nprobe(n: int, default: int = 8, most: int = 256) -> int:
    return n if 1 <= n <= most else default


def merged(config, *sources: dict):
    """config with values of the sources; the first source that has a value wins, unknown names are errors."""
    known = {f.name for f in fields(config)}
    values: dict = {}
    for source in sources:
        for k, v in source.items():
            if k not in known:
                raise KeyError(k)
            values.setdefault(k, v)
    return replace(config, **values)


@dataclass
class Profile:
    archive: ArchiveConfig = field(default_factory=ArchiveConfig)
    search: SearchConfig = field(default_factory=SearchConfig)


@dataclass(frozen=True)
class Request:
    """Parameters of a search request, typed and within bounds."""

    topn: int = 10
    query_id: int | None = None
    edge: bool = False
    nprobe: int = 8
    spec: str | None = None
    visualization: bool = False
    remarks: str | None = None
    min_tnn_dp: float = 0.6
    tnn_topk: int = 10
    tnn_indexes: int | None = None
    recall_true_neighbors: bool = False

    def search(self) -> SearchConfig:
        return SearchConfig(topn=self.topn, nprobe=self.nprobe, true_topk=self.tnn_topk, true_min_dp=self.min_tnn_dp)


#: Request names, the fields that they fill, and how values are read.
REQUEST_FIELDS = {
    "TOPN": ("topn", int), "QUERYID": ("query_id", int), "EDGE": ("edge", lambda x: x not in ("", "0", "false")), "NPROBE": ("nprobe", int), "SPEC": ("spec", str),
    "VISUALIZATION": ("visualization", lambda x: x not in ("", "0", "false")), "SPECREMARKS": ("remarks", str), "MINTNNDP": ("min_tnn_dp", float), "TNNTOPK": ("tnn_topk", int),
    "TNNINDEXNUM": ("tnn_indexes", int), "RECALLTRUENEIGHBOR": ("recall_true_neighbors", lambda x: x not in ("", "0", "false")),
}


def request(values: dict[str, str]) -> Request:
    """A Request of named texts: unknown names are ignored, values that cannot be read or lie out of bounds give the default."""
    out: dict = {}
    for name, value in values.items():
        if name.upper() in REQUEST_FIELDS:
            key, read = REQUEST_FIELDS[name.upper()]
            try:
                out[key] = read(value)
            except ValueError:
                continue
    if not 1 <= out.get("topn", 10) <= MAX_TOPN:
        del out["topn"]
    if not 1 <= out.get("tnn_topk", 10) <= MAX_TOPN:
        del out["tnn_topk"]
    if "nprobe" in out:
        out["nprobe"] = valid_nprobe(out["nprobe"])
    return Request(**out)
