import base64
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from peakforge.operators import encode
from peakforge.plans.archive import Archive
from peakforge.plans.config import ArchiveConfig, SearchConfig
from peakforge.sources import psms, sinks, spectra

MGF = """# a comment
BEGIN IONS
TITLE=first
PEPMASS=500.25
CHARGE=2+
RTINSECONDS=12.5
100.5 10
200.25 20.5
END IONS

BEGIN IONS
TITLE=run.7.7.2
PEPMASS=300
300.1 1e3
END IONS
"""
SPTXT = """### header
Name: PEPTIDEK/2
LibID: 0
PrecursorMZ: 464.25
Comment: Protein=1/DECOY_P1 RetentionTime=33.5,30,40 HCD=35.0
NumPeaks: 2
102.5\t10\tb1\t1
232.75\t20.5\ty2\t1

Name: AAM[147]K/3
LibID: 1
PrecursorMZ: 300
Comment: Protein=1/P2
NumPeaks: 1
150.5\t5\t?\t1
"""


def array(values, bits, inflate):
    raw = struct.pack(f"<{len(values)}{'d' if bits == 64 else 'f'}", *values)
    return base64.b64encode(zlib.compress(raw) if inflate else raw).decode()


def cv(accession, value="", unit=""):
    return f'<cvParam accession="{accession}" value="{value}" unitAccession="{unit}"/>'


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.mgf").write_text(MGF)
    (tmp_path / "b.sptxt").write_text(SPTXT)
    arrays = "".join(
        f"<binaryDataArray>{cv(kind)}{cv('MS:1000523' if bits == 64 else 'MS:1000521')}{cv('MS:1000574') if z else ''}<binary>{array(v, bits, z)}</binary></binaryDataArray>"
        for kind, v, bits, z in (("MS:1000514", [100.5, 200.5], 64, True), ("MS:1000515", [1.0, 2.0], 32, False))
    )
    (tmp_path / "c.mzML").write_text(
        f'<mzML><run><spectrumList><spectrum index="0" id="controller=1 scan=19" defaultArrayLength="2">{cv("MS:1000511", 2)}<scanList><scan>{cv("MS:1000016", 2, "UO:0000031")}</scan></scanList>'
        f'<precursorList><precursor><selectedIonList><selectedIon>{cv("MS:1000744", 450.5)}{cv("MS:1000041", 3)}</selectedIon></selectedIonList></precursor></precursorList>'
        f"<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum></spectrumList></run></mzML>"
    )
    pairs = base64.b64encode(struct.pack(">4f", 100.5, 1, 200.5, 2)).decode()
    (tmp_path / "d.mzXML").write_text(
        f'<mzXML><msRun><scan num="1" msLevel="1" retentionTime="PT1.5S"><peaks precision="32">{pairs}</peaks>'
        f'<scan num="2" msLevel="2" retentionTime="PT2.5S" collisionEnergy="35"><precursorMz precursorCharge="2">600.5</precursorMz><peaks precision="32">{pairs}</peaks></scan></scan></msRun></mzXML>'
    )
    (tmp_path / "e.scanlist").write_text(f"{tmp_path}/a.mgf\n7\n7\n99\n")
    (tmp_path / "interact-x.pep.xml").write_text(
        '<msms_pipeline_analysis><roc_error_data charge="all"><error_point error="0.01" min_prob="0.9"/><error_point error="0.05" min_prob="0.5"/></roc_error_data>'
        '<spectrum_query spectrum="a.00007.00007.2" start_scan="7" end_scan="7" precursor_neutral_mass="998.0" assumed_charge="2" index="1"><search_result>'
        '<search_hit hit_rank="1" peptide="PEMK" protein="DECOY_1"><alternative_protein protein="P9"/><modification_info><mod_aminoacid_mass position="3" mass="147.0354"/></modification_info>'
        '<search_score name="xcorr" value="2.5"/><analysis_result analysis="peptideprophet"><peptideprophet_result probability="0.95"/></analysis_result></search_hit></search_result></spectrum_query></msms_pipeline_analysis>'
    )
    (tmp_path / "t.tsv").write_text("filename\tscan\tmodpep\tcharge\tscore\na.mgf\t1\tAC[160]K\t2\t0.5\n")
    return tmp_path


def peaks(row):
    return [(p.mz, p.intensity) for p in row.peaks]


def test_mgf(spark, files):
    a, b = spectra.read_spectra(spark, f"{files}/a.mgf").orderBy("idx").collect()
    assert (a.scan, a.precursor_mz, a.charge, a.rt, peaks(a)) == (1, 500.25, 2, 12.5, [(100.5, 10.0), (200.25, 20.5)])
    assert (b.scan, b.charge, peaks(b)) == (7, 0, [(300.1, 1000.0)])


def test_library(spark, files):
    a, b = spectra.read_spectra(spark, f"{files}/b.sptxt").orderBy("idx").collect()
    assert (a.scan, a.charge, a.rt, a.protein, a.ce, peaks(a)[1]) == (1, 2, 33.5, "DECOY_P1", "35.0", (232.75, 20.5))
    assert (b.scan, b.protein, len(b.peaks)) == (2, "P2", 1)
    u = {r.scan: r for r in psms.updates_of(spark, f"{files}/b.sptxt").collect()}
    assert (u[1].significance, u[2].significance, u[2].peptide, u[2].modification) == (0, 1, "AAMK", "147.0000@3|")


def test_xml(spark, files):
    (r,) = spectra.read_spectra(spark, f"{files}/c.mzML").collect()
    assert (r.scan, r.ms_level, r.rt, r.precursor_mz, r.charge, peaks(r)) == (19, 2, 120.0, 450.5, 3, [(100.5, 1.0), (200.5, 2.0)])
    a, b = spectra.read_spectra(spark, f"{files}/d.mzXML").orderBy("scan").collect()
    assert (a.ms_level, b.ms_level, b.precursor_mz, b.charge, b.rt, b.ce, peaks(b)) == (1, 2, 600.5, 2, 2.5, "35", [(100.5, 1.0), (200.5, 2.0)])


def test_mzxml_times_with_an_exponent(spark, tmp_path):
    times = {1: "PT1.0E7S", 2: "PT2.25000025E7S", 3: "PT1.5e-4S", 4: "PT12S"}
    (tmp_path / "f.mzXML").write_text("<mzXML>" + "".join(f'<scan num="{n}" msLevel="2" retentionTime="{t}"><peaks precision="32"></peaks></scan>' for n, t in times.items()) + "</mzXML>")
    found = {r.scan: r.rt for r in spectra.read_spectra(spark, f"{tmp_path}/f.mzXML").collect()}
    assert found == {1: 1.0e7, 2: 22500002.5, 3: 1.5e-4, 4: 12.0}


def test_scanlist_and_files(spark, files):
    assert [r.scan for r in spectra.read_spectra(spark, f"{files}/e.scanlist").collect()] == [7]
    found = [r.path.rsplit("/", 1)[1] for r in spectra.find_files(spark, str(files), [".MZML", ".mzxml"]).collect()]
    assert found == ["c.mzML", "d.mzXML"]


def test_pepxml(spark, files):
    path = f"{files}/interact-x.pep.xml"
    (r,) = psms.read_pepxml(spark, path).collect()
    assert (r.peptide, r.protein, r.xcorr, r.pprob, r.mods, r.is_decoy) == ("PEMK", "P9", 2.5, 0.95, {3: 147.0354}, 0)
    (u,) = psms.updates_of(spark, path).collect()
    assert u.significance == 1 and u.precursor == pytest.approx(998 / 2 + 1.007276) and u.modification == "147.0354@3|"
    assert psms.at_level(psms.read_pepxml(spark, path), psms.read_error_points(spark, path), path).count() == 1


def test_tables_and_requests(spark, files):
    (u,) = psms.updates_of(spark, f"{files}/t.tsv").collect()
    assert (u.peptide, u.modification, u.charge, u.score) == ("ACK", "160.0000@2|", 2, 0.5)
    assert spectra.read_table(spark, f"{files}/t.tsv", header=False).columns[0] == "C0"
    assert spectra.parse_request("TOPN=10;queryid=3") == {"TOPN": "10", "QUERYID": "3"}
    assert [r.bin for r in spectra.inline_spectrum(spark, "5,9,0,7").orderBy("rank").collect()] == [5, 9]
    raw = spectra.inline_spectrum(spark, "#raw#" + "_".join(f"{100 + i}:{i}" for i in range(1, 9)))
    assert raw.count() == 8
    kv = spark.range(1).select(spectra.parse_key_values(F.lit('a=1 b="x y" c=z')).alias("m")).first().m
    assert kv == {"a": "1", "b": "x y", "c": "z"}


def test_compact_files(spark, tmp_path):
    df = spark.createDataFrame([(0, [5, 7]), (1, [9])], "spec_id bigint, bins array<int>")
    sinks.write_compact(df, f"{tmp_path}/x.mz")
    back = spectra.read_compact(spark, f"{tmp_path}/x.mz").orderBy("idx").collect()
    assert [r.bins[:3] for r in back] == [[5, 7, 0], [9, 0, 0]]


def test_archive(spark, tmp_path):
    rng = __import__("random").Random(1)
    base = [(200.0 + 20 * k, float(rng.randint(10, 1000))) for k in range(30)]
    rows = [("/x/one.mgf", s, s - 1, 2, 1.0 * s, 900.0, 2, "n", None, None, [(m + 0.001 * s, i) for m, i in base]) for s in range(1, 6)]
    df = spark.createDataFrame(rows, spectra.SPECTRA)
    a = Archive(spark, str(tmp_path / "archive"), ArchiveConfig())
    assert (a.add(df), a.add(df), a.size()) == (5, 0, 5)
    near = a.search(a.queries([0]), SearchConfig(topn=3)).collect()
    assert len(near) == 3 and near[0].dist < 0.3
    assert a.search_file("one", 2, 3).count() == 2
    a.update_with(spark.createDataFrame([("one", 2, "PEP", 1)], "filename string, scan int, peptide string, significance int"))
    assert [r.scan for r in a.search_peptide("PEP").collect()] == [2]
    assert '"nodes"' in a.graph(a.queries([0])).first().json
    assert a.p_values(a.queries([0]), a.search(a.queries([0]))).first().p == 10000
    assert a.batch_search(a.queries([0])).count() == 0
    a.store_neighbors(0, 2)
    stored = {r.id: r.neighbor for r in a.table("ground_truth").collect()}
    assert len(stored[0]) == 4 and stored[3] is None
    assert a.recall(a.queries([0]), near_ids := a.search(a.queries([0]))).first().found == 1 and near_ids.count() == 5
    a.add_remark(3, "look")
    assert a.remarks(3).first().remarks == "look" and a.summary().count() > 0 and a.to_repair().count() == 0
    a.add(df.withColumn("file", F.lit("/x/two.mgf")))
    a.remove(1)
    assert a.size() == 5 and a.files_to_remove_for(4) == 1


def test_stream(spark, tmp_path):
    from peakforge.streaming.ingest import follow

    a = Archive(spark, str(tmp_path / "archive"))
    row = ("/x/f.mgf", 1, 0, 2, 1.0, 900.0, 2, "n", None, None, [(200.0 + 30 * k, 10.0 + k) for k in range(10)])
    spark.createDataFrame([row], spectra.SPECTRA).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        follow(spark, a, str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination()
    assert a.size() == 1 and encode.norms(a.table("peaks")).first().n_peaks > 6
