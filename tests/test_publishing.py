"""Each submission has exactly one version, whatever happens to a run."""

import datetime
import glob
import json
from types import SimpleNamespace

import pytest

from ledgerbeam.operators.segments import segment_sheet, union_sheets
from ledgerbeam.plans.convert import convert_batch
from ledgerbeam.plans.file_queries import _folder
from ledgerbeam.sinks import files
from ledgerbeam.sinks.files import file_conversion, write_submissions
from ledgerbeam.sources.bureau_files import read_lines
from ledgerbeam.specs.registry import get_format
from ledgerbeam.specs import microfinance
from ledgerbeam.storage import filesystem, published, qualified, shared_path

FMT = microfinance.CDF


@pytest.fixture(scope="module")
def meta(spark):
    day = datetime.date(2026, 7, 31)
    return spark.createDataFrame([(s, "MBR1", "Lender", None, day, day, None, {}) for s in ("S1", "S2", "S3")],
                                 "submission_id string, member_id string, member_name string, member_short_name string, reporting_date date, creation_date date, password string, extras map<string,string>")


def conversion(spark, meta, names, emit=True):
    rows = [(s, f"M{k}", k, f"{n}{k}") for s, n in names.items() for k in range(40)]
    seg = union_sheets(segment_sheet(spark.createDataFrame(rows, "submission_id string, ac_no string, row_no int, memberIdentifier string"), FMT, "CNSCRD"))
    return convert_batch(seg, meta, FMT, emit_with_errors=emit)


def held(path, sid):
    """The bytes that the manifest stands for, and all part files in the submission's folder."""
    manifest = json.load(open(path / "_manifests" / f"{sid}.json"))
    return b"".join(open(path / p, "rb").read() for p in manifest["parts"]), sorted(glob.glob(str(path / f"submission_id={sid}" / "*")))


def test_reruns_and_gated_reruns_leave_one_version(spark, meta, tmp_path):
    path = tmp_path / "out"
    file_conversion(conversion(spark, meta, {"S1": "A", "S2": "B"}), meta, FMT, str(path), "101112")
    first, listed = held(path, "S1")
    assert b"|A0" in first and len(listed) == len(json.load(open(path / "_manifests/S1.json"))["parts"]) > 0
    assert held(path, "S3")[0].startswith(b"HDR") and held(path, "S2")[0]  # let through, with nothing but its header
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        file_conversion(conversion(spark, meta, {"S1": "A", "S2": "C"}), meta, FMT, str(path), "101112")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert held(path, "S1")[0] == first and b"|C0" in held(path, "S2")[0] and b"|B0" not in held(path, "S2")[0]
    # all submissions are gated now: no earlier file stands for them
    file_conversion(conversion(spark, meta, {"S1": "A"}, emit=False), meta, FMT, str(path), "101112")
    assert held(path, "S1") == held(path, "S2") == held(path, "S3") == (b"", [])
    assert {r.submission_id: (r.name, r.bytes) for r in published(spark, str(path)).collect()} == {s: (f"submission{FMT.extension}", 0) for s in ("S1", "S2", "S3")}


def test_a_failure_between_two_submissions(spark, meta, tmp_path, monkeypatch):
    path = tmp_path / "out"
    file_conversion(conversion(spark, meta, {"S1": "A", "S2": "B"}), meta, FMT, str(path), "101112")
    old = {s: held(path, s)[0] for s in ("S1", "S2")}
    writer = files.SubmissionFileWriter({"path": str(path)})
    (path / "submission_id=S1" / f"part-000000-{writer.job}-7.txt").write_bytes(b"new S1")
    (path / "submission_id=S2" / f"part-000000-{writer.job}-8.txt").write_bytes(b"new S2")
    message = files.Parts([("S1", f"part-000000-{writer.job}-7.txt", 6), ("S2", f"part-000000-{writer.job}-8.txt", 6)], {}, {})
    put = files.replace_file
    with monkeypatch.context() as broken:
        broken.setattr(files, "COMMIT_THREADS", 1)
        broken.setattr(files, "replace_file", lambda target, name, data: put(target, name, data) if "S1" in name else (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            writer.commit([message])
    assert held(path, "S1")[0] == b"new S1" and held(path, "S2")[0] == old["S2"]
    got = {r.submission_id: r.line for r in read_lines(spark, str(path)).filter("submission_id = 'S1'").collect()}
    assert got == {"S1": "new S1"}
    writer.commit([message])  # tried again
    assert held(path, "S2") == (b"new S2", [str(path / f"submission_id=S2/part-000000-{writer.job}-8.txt")])


def test_an_odd_character_stops_its_submission_only(spark, meta, tmp_path):
    path = tmp_path / "out"
    done = conversion(spark, meta, {"S1": "A", "S2": "漢"})
    file_conversion(done, meta, FMT, str(path), "101112")
    rows = {r.submission_id: r for r in published(spark, str(path)).collect()}
    assert rows["S1"].fault is None and rows["S1"].parts and "漢" in rows["S2"].fault and rows["S2"].parts == [] and held(path, "S2") == (b"", [])
    write_submissions(done.records, FMT, str(path), unmappable="replace")
    assert b"|?0" in held(path, "S2")[0]


def test_manifests_hold_the_upload_name(spark, meta, tmp_path):
    fmt = get_format("commercial-ucrf-flat-v310")
    names = meta.select("submission_id", files.submission_name(fmt, "101112").alias("file_name"))
    write_submissions(conversion(spark, meta, {"S1": "A"}).records.limit(0), FMT, str(tmp_path), submissions=names)
    assert {r.name for r in published(spark, str(tmp_path)).collect()} == {f"MBR1_Commercial_31072026_31072026_101112_ME{fmt.extension}"}
    assert published(spark, str(tmp_path / "none")) is None


def test_folders_of_queries_name_their_file_system(spark, tmp_path):
    """A cluster refuses a path without one (F1: stream_read_back failed there whenever spark.checkpoint.dir had none)."""
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"))
    folder = _folder(spark, "tudf")
    assert shared_path(cluster, folder) == folder
    with pytest.raises(ValueError):
        shared_path(cluster, str(tmp_path))
    named = qualified(spark, str(tmp_path))
    assert named == f"file:{tmp_path}" == qualified(spark, named) and filesystem(named)[1] == str(tmp_path)
