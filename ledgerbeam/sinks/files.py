"""Byte-exact submission files, published by manifest.

Rows come range-partitioned and sorted by (submission, position).  Every task writes the runs of rows it holds as numbered part
files that are never changed or renamed; the parts of a submission, in the order its manifest lists them, are its file, so a submission of
any size is written by as many tasks as it needs.  A submission changes from one version to the next when its manifest is
replaced, one small file; until then, and if the job fails between two submissions, readers that follow manifests see the earlier version
whole.  A submission of the run without records, such as a gated one, gets a manifest without parts, so that no earlier file stands for it.
Parts that no manifest lists any more are deleted after the manifest is in place."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.assemble import RECORD_ORDER, in_file_order, physical_records, submission_name
from ..specs.model import Format
from ..storage import MANIFESTS, filesystem, shared_path

#: Manifests that the driver writes at a time.
COMMIT_THREADS = 16


@dataclass
class Parts(WriterCommitMessage):
    """What a task has written: (submission, part file, bytes), the names of submissions, and what could not be written."""

    files: list[tuple[str, str, int]]
    names: dict[str, str]
    faults: dict[str, str]


def replace_file(target: fs.FileSystem, path: str, data: bytes) -> None:
    """Writes a small file whole: where a file would show before it is closed, under another name that is moved over the old one."""
    whole = isinstance(target, (fs.LocalFileSystem, fs.HadoopFileSystem))
    place = f"{path}.{uuid.uuid4().hex}.tmp" if whole else path
    with target.open_output_stream(place) as out:
        out.write(data)
    if whole:
        target.move(place, path)


class SubmissionFileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.extension = options["path"].rstrip("/"), options.get("extension", ".txt")
        self.charset = options.get("charset", "latin-1")
        # Characters the charset lacks: the submission is not published by default; '?' is written when asked to.
        self.errors = options.get("unmappable", "strict")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        target, base = filesystem(self.path)
        task = TaskContext.get()
        done, current, out = Parts([], {}, {}), None, None
        part = f"part-{task.partitionId():06d}-{self.job}-{task.taskAttemptId()}{self.extension}"

        def close() -> None:
            if out:
                done.files.append((current, part, out.tell()))
                out.close()

        try:
            for batch in iterator:
                for sid, name, text in zip(*[batch.column(c).to_pylist() for c in ("submission_id", "name", "text")], strict=True):
                    if text is None:  # announces the submission
                        done.names[sid] = name
                        continue
                    if sid != current:
                        close()
                        current, folder = sid, posixpath.join(base, f"submission_id={sid}")
                        target.create_dir(folder, recursive=True)
                        out = target.open_output_stream(posixpath.join(folder, part))
                    if sid in done.faults:
                        continue
                    try:
                        out.write(text.encode(self.charset, self.errors))
                    except UnicodeEncodeError as e:
                        done.faults[sid] = f"{text[e.start]!r} is not in {self.charset}"
        finally:
            close()
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Replaces the manifest of each submission of the run; others are left alone."""
        target, base = filesystem(self.path)
        sent = [m for m in messages if m]
        names = {sid: name for m in sent for sid, name in m.names.items()}
        faults = {sid: text for m in sent for sid, text in m.faults.items()}
        parts: dict[str, list[tuple[str, int]]] = {}
        for sid, part, size in (f for m in sent for f in m.files):
            parts.setdefault(sid, []).append((part, size))
        target.create_dir(posixpath.join(base, MANIFESTS), recursive=True)

        def publish(sid: str) -> None:
            kept = [] if sid in faults else sorted(parts.get(sid, []))
            text = {"submission_id": sid, "name": names.get(sid), "job": self.job, "bytes": sum(n for _, n in kept), "fault": faults.get(sid),
                    "parts": [f"submission_id={sid}/{p}" for p, _ in kept]}
            replace_file(target, posixpath.join(base, MANIFESTS, f"{sid}.json"), json.dumps(text).encode())
            self._drop(target, posixpath.join(base, f"submission_id={sid}"), keep={p for p, _ in kept})

        with ThreadPoolExecutor(COMMIT_THREADS) as pool:
            list(pool.map(publish, sorted(parts.keys() | names.keys())))

    @staticmethod
    def _drop(target: fs.FileSystem, folder: str, keep: set[str] = frozenset(), job: str = "") -> None:
        for info in target.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.is_file and info.base_name not in keep and job in info.base_name:
                target.delete_file(info.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Deletes the parts of this job that are known; any others are deleted when their submission is published next."""
        target, base = filesystem(self.path)
        for sid in {f[0] for m in messages if m for f in m.files}:
            self._drop(target, posixpath.join(base, f"submission_id={sid}"), job=self.job)


class SubmissionFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "submission_files"

    def schema(self) -> str:
        return "submission_id string, name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return SubmissionFileWriter(dict(self.options))


def write_submissions(records: DataFrame, fmt: Format, path: str, small: bool = True, mode: str = "append",
                      unmappable: str = "strict", submissions: DataFrame | None = None) -> None:
    """Publish every submission of an assembled batch under ``path``.

    ``submissions`` (submission_id, file_name) lists all submissions of the run: one without records is published without parts, and
    the manifest holds the name to file under."""
    spark: SparkSession = records.sparkSession
    spark.dataSource.register(SubmissionFiles)
    pieces = physical_records(records, fmt, small)
    if submissions is not None:
        zero = {c: F.lit(0).cast(pieces.schema[c].dataType) for c in RECORD_ORDER} | {"band": F.lit(-1)}
        heads = submissions.select("submission_id", *[zero[c].alias(c) for c in RECORD_ORDER], F.lit(None).cast("string").alias("text"), F.col("file_name").alias("name"))
        pieces = pieces.withColumn("name", F.lit(None).cast("string")).unionByName(heads)
    else:
        pieces = pieces.withColumn("name", F.lit(None).cast("string"))
    pieces = in_file_order(pieces).select("submission_id", "name", "text")
    pieces.write.format("submission_files").mode(mode).option("path", shared_path(spark, path)).option("extension", fmt.extension).option(
        "charset", "latin-1").option("unmappable", unmappable).save()


def file_conversion(conversion, meta: DataFrame, fmt: Format, path: str, run_time: str, unmappable: str = "strict") -> None:
    """Publish a conversion (see plans.convert): every submission of ``meta``, gated ones without parts, under its upload name."""
    name: Column = submission_name(fmt, run_time)
    write_submissions(conversion.records, fmt, path, conversion.small, unmappable=unmappable, submissions=meta.select("submission_id", name.alias("file_name")))
