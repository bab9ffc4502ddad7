import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerbeam.operators.partitioning import cut
from ledgerbeam.sources import streams
from ledgerbeam.sources.streams import BAD, DONE, FRESH, HEAD, MID, Grammar, read_stream, stream_issues
from ledgerbeam.specs.consumer import TUDF

HEADER = "TUDF12".ljust(146)
MARKERS = {s.tag: s.tlv_prefix or "ES02**" for s in TUDF.body}


def subject(rng, name):
    """(tag, values) of a subject; some values hold the end marker, the trailer or other markers."""
    odd = ["ES02**", "xES02**", "ES02**y", "TRLR", "PN03N01", "ES02**TRLR", "0105", "é", "", "x" * 99, "a" * 93 + "ES02**"]
    out = []
    for s in TUDF.body:
        if s.tag == "ES":
            out.append((s.tag, ["ES02**"]))
        elif s.tag == "PN" or rng.random() < 0.6:
            out.append((s.tag, [name if f.key == "name" else rng.choice(odd) if rng.random() < 0.5 else f"v{rng.randint(0, 9999)}" for f in s.fields]))
    return out


def encoded(records):
    return "".join(MARKERS[t] + ("" if t == "ES" else "".join(f"{f.tlv}{len(v):02d}{v}" for f, v in zip(TUDF.segment(t).fields, values) if v)) for t, values in records)


@pytest.mark.parametrize("block", [1, 300, 1 << 20])
def test_streams_read_back_across_any_cut(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(streams, "BLOCK_BYTES", block)
    rng, want = random.Random(block), {}
    for k in range(3):
        subjects = [subject(rng, f"{k} {i}") for i in range(60)]
        want[f"T{k}"] = [r for s in subjects for r in s]
        text = HEADER + encoded(want[f"T{k}"]) + "TRLR" + ("\r\n" if k == 2 else "")
        (tmp_path / "in").mkdir(exist_ok=True)
        if k:  # one file
            (tmp_path / "in" / f"T{k}.tudf").write_bytes(text.encode("latin-1"))
            continue
        folder = tmp_path / "in" / "submission_id=T0"  # part files, cut between segments
        folder.mkdir()
        parts = [HEADER, *[encoded([r]) for r in want["T0"]], "TRLR"]
        for p in range(0, len(parts), 50):
            (folder / f"part-{p:06d}.tudf").write_bytes("".join(parts[p : p + 50]).encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        done = read_stream(spark, str(tmp_path / "in"), TUDF)
        rows = done.records.orderBy(*streams.PLACE, "part").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {k: [(r.tag, list(r["values"])) for r in rows if r.submission_id == k] for k in want}
    assert got == want and done.faults.isEmpty() and not any(r.unknown for r in rows)
    subjects = {(r.submission_id, r.file, r.block_start, r.n, r.subject) for r in rows}
    assert len(subjects) == 180 and len({(r.file, r.block_start) for r in rows}) >= 4


def test_broken_streams_give_a_fault_and_no_records(spark, tmp_path):
    good = HEADER + encoded(subject(random.Random(1), "A")) + "TRLR"
    files = {"good": good, "cut": good[:-10], "untrailed": good[:-4], "odd": good.replace("PN03N01", "PN03N0x", 1), "more": good + "PN03N01", "bare": HEADER + "TRLR", "short": "TUDF", "length": HEADER + "PN03N0101ZZ" + "TRLR"}
    for name, text in files.items():
        (tmp_path / f"{name}.tudf").write_bytes(text.encode("latin-1"))
    done = read_stream(spark, str(tmp_path), TUDF)
    assert {r.submission_id for r in done.records.select("submission_id").distinct().collect()} == {"good"}
    assert {r.submission_id for r in done.faults.collect()} == set(files) - {"good", "bare"}
    issues = stream_issues(done.faults, TUDF).collect()
    assert len(issues) == 6 and all(i.severity == "error" and not i.bypassable for i in issues)


def test_unknown_codes_are_listed(spark, tmp_path):
    (tmp_path / "U.tudf").write_text(HEADER + "PN03N010102AB4402CDES02**TRLR")
    r = read_stream(spark, str(tmp_path), TUDF).records.filter("tag = 'PN'").first()
    assert r["values"][0] == "AB" and list(r.unknown) == ["44"]


def test_maps_of_blocks():
    g = Grammar(TUDF)
    m = g.transfer(b"PN03N010103ABCES02**")
    assert m[FRESH] == m[MID] == FRESH and m[DONE] == m[BAD] == m[HEAD] == BAD
    assert m[7] == FRESH and m[20] == MID and m[25] == 5 and m[3] == BAD
    assert g.transfer(b"PN03N010110AB")[FRESH] == 8 and g.transfer(b"TRLR\r\n")[FRESH] == DONE and g.transfer(b"TRLRx")[FRESH] == BAD
    assert g.transfer(b"ES02**0102ABTRLR")[8] == MID or g.transfer(b"ES02**0102ABTRLR")[FRESH] == DONE


def test_bytes_move_only_where_a_subject_crosses_blocks(spark, tmp_path):
    (tmp_path / "P.tudf").write_text(HEADER + encoded(subject(random.Random(2), "A")) + "TRLR")
    plan = read_stream(spark, str(tmp_path), TUDF).records._jdf.queryExecution().executedPlan().toString()
    easy = plan.split("Union")[1].split("ObjectHashAggregate")[0] if "ObjectHashAggregate" in plan else plan
    assert "BroadcastHashJoin" in easy


def test_a_task_holds_little_of_a_stream_at_a_time(spark, monkeypatch):
    """blocks of a whole batch were taken apart before any was handed on, and a task read and wrote a hundred of one MB at a time."""
    body, want = "", []
    for i in range(40):
        records = subject(random.Random(i), str(i))
        body, want = body + encoded(records), want + [list(values) for _, values in records]
    batch = pa.record_batch([pa.array(v, k) for v, k in zip((["U"], ["f"], [0], [0], [0], [FRESH], [body.encode("latin-1")]),
                                                            (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], [*streams.PLACE, "entry", "body"])
    monkeypatch.setattr(streams, "SEGMENTS", 50)
    got = list(streams._cut_fields(Grammar(TUDF))(iter([batch])))
    assert [v for b in got for v in b.column("values").to_pylist()] == want and {b.num_rows for b in got[:-1]} == {50}
    assert streams.BLOCK_BYTES * 100 <= streams.GROUP_BYTES  # rows after which a writer first looks at what it holds


def test_tables_of_large_values_are_written_in_small_groups(spark):
    rows = spark.range(0, 600, 1, 1).selectExpr("id", "array_join(transform(sequence(1, 100), i -> sha2(concat(id, i), 512)), '') as body")  # 7 MB
    plain, small = cut(rows, "large"), cut(rows, "large", 1 << 20)
    groups = [sum(pq.ParquetFile(f.removeprefix("file:")).num_row_groups for f in df.inputFiles()) for df in (plain, small)]
    assert groups[0] == 1 < groups[1] and small.exceptAll(plain).isEmpty()
