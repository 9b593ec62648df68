"""Command line of an archive: ``python -m peakforge PATH init|add|update|search|summary|remove ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.archive import Archive
from .plans.config import ArchiveConfig, SearchConfig, merged
from .sources import sinks
from .sources.spectra import find_files, read_spectra

#: What a folder is searched for: raw data at the start, and libraries, lists and annotation too when an archive grows.
INIT, ADD = [".mzxml", ".mzml"], [".mzml", ".mzxml", ".mgf", ".sptxt", ".scanlist"]
ANNOTATION = [".spectroscape.tsv", ".psm.all", ".pep.xml", ".pepxml"]


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="peakforge", description=__doc__)
    p.add_argument("path", help="folder of the archive")
    p.add_argument("action", choices=("init", "add", "update", "train", "search", "summary", "remove", "repair", "compact"))
    p.add_argument("inputs", nargs="*", help="files or folders; ids to search; the number of files to remove")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting; what is given here wins over the settings file")
    p.add_argument("--settings", help="a file of NAME=VALUE lines")
    p.add_argument("--out", help="folder for results")
    p.add_argument("--yes", action="store_true", help="do not ask before removing")
    return p


def settings(pairs: list[str], path: str | None) -> tuple[dict, dict]:
    """(given, from the file): values of settings, read as the type of their defaults."""

    def read(lines) -> dict:
        out, known = {}, {**vars(ArchiveConfig()), **vars(SearchConfig())}
        for line in lines:
            name, _, value = line.strip().partition("=")
            if name and not name.startswith("#"):
                old = known[name]
                out[name] = value.lower() in ("1", "true", "yes") if isinstance(old, bool) else tuple(type(old[0])(x) for x in value.split(";")) if isinstance(old, tuple) else type(old)(value)
        return out

    return read(pairs), read(open(path)) if path else {}


def found(spark: SparkSession, inputs: list[str], suffixes: list[str]) -> list[str]:
    """Files named, and those below folders named whose names end alike."""
    out = []
    for x in inputs:
        own = [x] if x.lower().endswith(tuple(suffixes)) else [r.path for r in find_files(spark, x, suffixes).select("path").collect()]  # file names
        out += own
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("peakforge").getOrCreate()
    given, stored = settings(a.set, a.settings)
    of = lambda config: [{k: v for k, v in x.items() if hasattr(config, k)} for x in (given, stored)]
    archive = Archive(spark, a.path, merged(ArchiveConfig(), *of(ArchiveConfig())))
    config = merged(SearchConfig(), *of(SearchConfig()))
    if a.action in ("init", "add"):
        if a.action == "init" and archive.store.version():
            raise SystemExit("there is an archive already; add to it")
        n = sum(archive.add(read_spectra(spark, x)) for x in found(spark, a.inputs, INIT if a.action == "init" else ADD))
        print(f"{n} spectra added, {archive.size()} in all")
    elif a.action == "update":
        for x in found(spark, a.inputs, ANNOTATION):
            archive.update(x)
    elif a.action == "train":
        print(f"{archive.train()} indexes trained")
    elif a.action == "search":
        report = archive.batch_search(archive.queries([int(x) for x in a.inputs]), config)
        sinks.write_tsv(report, a.out) if a.out else report.show(1000, truncate=False)
    elif a.action == "remove":
        if not a.yes and input(f"remove the last {a.inputs[0]} files? [y/N] ").strip().lower() != "y":
            return 1
        archive.remove(int(a.inputs[0]))
    elif a.action == "repair":
        print(f"{archive.repair()} encoded, {archive.to_repair().count()} without peaks")
    elif a.action == "compact":
        archive.compact()
    else:
        archive.summary().show(200, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
