"""Column functions on masses, peptides, modifications, names and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.config import PROTON

#: Monoisotopic residue masses. X, B, J and Z stand for unknown, modified or no residues, with the masses that archives give them.
#: D is 115.02694; an archive that has 115.02964 for it holds a slip of digits, which is not repeated here.
RESIDUES = {
    "G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293,
    "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931,
    "X": 101.0, "B": 103.00919, "J": 131.04049, "Z": 0.0,
}
WATER = 18.010565


def neutral_mass(mz: Column, charge: Column) -> Column:
    return mz * charge - charge * PROTON


def mz_of_mass(mass: Column, charge: Column) -> Column:
    return (mass + charge * PROTON) / charge


def repaired_charge(charge: Column, peptide: Column, precursor_mz: Column) -> Column:
    """Charge 0 of a known peptide is guessed from a mean residue mass of 111."""
    known = peptide.isNotNull() & ~peptide.isin("", "UNKNOWN") & (precursor_mz > 0)
    return F.when((charge == 0) & known, F.round(111.0 * F.length(peptide) / precursor_mz).cast("int")).otherwise(charge)


def same_peptide(a: Column, b: Column) -> Column:
    """I and L are alike."""
    return F.translate(a, "I", "L") == F.translate(b, "I", "L")


def modified_peptide(peptide: Column, mods: Column, nterm: Column | None = None) -> Column:
    """``n[43]PEM[147]``: residues with the rounded mass of their modification. mods: map of place (from 1) to mass."""
    rounded = lambda m: F.concat(F.lit("["), F.round(m).cast("int").cast("string"), F.lit("]"))
    residues = F.filter(F.split(peptide, ""), lambda x: x != "")
    body = F.array_join(F.transform(residues, lambda x, i: F.concat(x, F.coalesce(rounded(F.try_element_at(mods, i + 1)), F.lit("")))), "")
    head = F.lit("") if nterm is None else F.coalesce(F.when(nterm > 0, F.concat(F.lit("n"), rounded(nterm))), F.lit(""))
    return F.concat(head, body)


def parsed_peptide(text: Column) -> Column:
    """struct(peptide, nterm, mods) of ``n[43]PEM[147]K`` (flanking ``X.`` and ``.X`` are dropped)."""
    core = F.regexp_replace(F.regexp_replace(text, r"^[A-Z\-]\.", ""), r"\.[A-Z\-]$", "")
    nterm = F.regexp_extract(core, r"^n\[([0-9.]+)\]", 1)
    body = F.regexp_replace(F.regexp_replace(core, r"^n\[[0-9.]+\]", ""), r"c\[[0-9.]+\]$", "")
    units = F.regexp_extract_all(body, F.lit(r"([A-Z](?:\[[0-9.+\-]+\])?)"), F.lit(1))
    places = F.transform(units, lambda u, i: F.struct((i + 1).alias("k"), F.regexp_extract(u, r"\[([0-9.+\-]+)\]", 1).alias("m")))
    mods = F.map_from_entries(F.transform(F.filter(places, lambda p: p["m"] != ""), lambda p: F.struct(p["k"], p["m"].cast("double"))))
    return F.struct(
        F.regexp_replace(body, r"[^A-Z]+", "").alias("peptide"), F.when(nterm != "", nterm.cast("double")).otherwise(0.0).alias("nterm"), mods.alias("mods")
    )


def mods_text(mods: Column) -> Column:
    """``147.0354@4|160.0306@8|`` of a map, by place; ``UNMODIFIED`` of an empty one."""
    entries = F.array_sort(F.map_entries(mods))
    parts = F.transform(entries, lambda e: F.concat(F.format_string("%.4f", e["value"]), F.lit("@"), e["key"].cast("string"), F.lit("|")))
    return F.when(F.size(entries) > 0, F.array_join(parts, "")).otherwise("UNMODIFIED")


def parsed_mods(text: Column) -> Column:
    parts = F.filter(F.split(text, r"\|"), lambda x: x.contains("@"))
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.split(x, "@")[1].cast("int"), F.split(x, "@")[0].cast("double"))))


def is_decoy(protein: Column) -> Column:
    return F.coalesce(F.contains(F.upper(protein), F.lit("DECOY")), F.lit(False))


def chosen_protein(protein: Column, alternatives: Column) -> Column:
    """The protein, or for a decoy the first alternative that is none."""
    real = F.filter(alternatives, lambda x: ~is_decoy(x))
    return F.when(is_decoy(protein), F.coalesce(F.get(real, F.lit(0)), protein)).otherwise(protein)


def spectrum_name(base: Column, scan: Column, charge: Column) -> Column:
    return F.format_string("%s.%05d.%05d.%d", base, scan, scan, charge)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def is_sql_safe(text: Column) -> Column:
    """Whether a text has none of the characters that the literal form of a statement cannot hold; here all values are parameters."""
    return ~text.rlike("[;%'\"]")


def theoretical_ions(peptides: DataFrame, peptide: str = "peptide", charge: str = "charge") -> DataFrame:
    """peptides with (kind, position, z, mz): b and y ions for charges 1 to the peptide's; all m/z are null where a letter has no mass."""
    keys = peptides.columns
    masses = F.create_map(*[x for k, v in RESIDUES.items() for x in (F.lit(k), F.lit(v))])
    each = peptides.select(*keys, F.posexplode(F.filter(F.split(peptide, ""), lambda x: x != "")).alias("p", "residue")).withColumn("m", F.try_element_at(masses, F.col("residue")))
    own = W.partitionBy(*keys)
    known = F.min(F.col("m").isNotNull()).over(own)
    sums = (
        each.withColumn("b", F.when(known, F.sum("m").over(own.orderBy("p").rowsBetween(W.unboundedPreceding, 0))))
        .withColumn("all", F.when(known, F.sum("m").over(own)))
        .withColumn("n", F.count(F.lit(1)).over(own))
        .where("p + 1 < n")
    )
    kinds = F.array(
        F.struct(F.lit("b").alias("kind"), (F.col("p") + 1).alias("position"), F.col("b").alias("mass")),
        F.struct(F.lit("y").alias("kind"), (F.col("n") - F.col("p") - 1).cast("int").alias("position"), (F.col("all") - F.col("b") + WATER).alias("mass")),
    )
    ions = sums.select(*keys, F.explode(kinds).alias("i"))
    ions = ions.withColumn("z", F.explode(F.sequence(F.lit(1), F.greatest(F.col(charge), F.lit(1)))))
    return ions.select(*keys, "i.kind", "i.position", "z", ((F.col("i.mass") + F.col("z") * PROTON) / F.col("z")).alias("mz"))


def annotated_peaks(peaks: DataFrame, ions: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """peaks (spec_id, mz, ...) with the nearest ion (spec_id, kind, position, z, mz) within the tolerance."""
    k = F.floor(F.col("mz") / tolerance)
    left = peaks.withColumn("__k", F.explode(F.array(k - 1, k, k + 1)))
    right = ions.select(F.col("spec_id"), k.alias("__k"), F.col("mz").alias("ion_mz"), "kind", "position", "z")
    gap = F.abs(F.col("mz") - F.col("ion_mz"))
    best = left.join(right, ["spec_id", "__k"]).where(gap <= tolerance).groupBy("spec_id", "mz").agg(F.min(F.struct(gap.alias("gap"), "ion_mz", "kind", "position", "z")).alias("ion"))
    return peaks.join(best, ["spec_id", "mz"], "left")
