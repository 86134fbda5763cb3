"""Archives of jobs as a sink (K5, T5): a ZIP for each job, written by the tasks that hold its files, and visible only when all tasks have succeeded.

Every attempt of a task writes below a hidden folder of its own. The commit on the driver moves the archives of the attempts that succeeded to their
place and removes the rest; an aborted job leaves nothing. Paths may be of any file system that Arrow can open."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zipfile import ZIP_DEFLATED, ZipFile, ZipInfo

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators import export

SCHEMA = "job string, seq long, path string, data binary"
#: Time that every entry bears, so that equal files give equal archives.
EPOCH = (1980, 1, 1, 0, 0, 0)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.hidden = path, f"_writing-{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return system, root.rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        """Rows of one job come one after the other."""
        system, root = self._open()
        folder, names, job, stream, archive = f"{root}/{self.hidden}/{uuid.uuid4().hex}", [], None, None, None
        system.create_dir(folder, recursive=True)
        try:
            for row in iterator:
                if row.job != job:
                    if archive:
                        archive.close()
                        stream.close()
                    job = row.job
                    name = f"{job}.zip"
                    if name in names:
                        raise ValueError("files of one archive must come together")
                    if "/" in name or "\\" in name or row.job in ("", ".", ".."):
                        raise ValueError("an archive's name must be a file name")
                    names.append(name)
                    stream = system.open_output_stream(f"{folder}/{name}")
                    archive = ZipFile(stream, "w", compression=ZIP_DEFLATED)
                info = ZipInfo(row.path, EPOCH)
                info.compress_type = ZIP_DEFLATED
                archive.writestr(info, bytes(row.data))
            if archive:
                archive.close()
                stream.close()
        except BaseException:
            system.delete_dir(folder)
            raise
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._open()
        for m in filter(None, messages):
            for name in m.names:
                system.move(f"{m.folder}/{name}", f"{root}/{name}")
        self.abort([])

    def abort(self, messages: list) -> None:
        system, root = self._open()
        if system.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.hidden}")


class Archives(DataSource):
    """``df.write.format("archives").mode("append").save(folder)`` for rows of ``SCHEMA``; register it with the session first."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def archive_files(entries: DataFrame, job: str) -> DataFrame:
    """The files of archives as rows of ``SCHEMA``: ``manifest.json`` first (version 1, every document of the job with its status, error and files), then the payloads
    of completed documents in order. ``entries``: ``job, seq, filename, status, error`` and payload columns, as of ``export.archive_entries``."""
    stemmed = export.archive_manifest(entries, keep=[job, "error", *[c for c, _ in export.PAYLOADS if c in entries.columns]])
    document = F.struct(F.col("filename").alias("source_filename"), "status", "error", "files")
    order = F.struct("seq", document.alias("document"))

    @F.udf("binary")
    def manifest(documents):
        found = [{"source_filename": d.source_filename, "status": d.status, "error": d.error, "files": list(d.files)} for _, d in documents]
        return json.dumps({"version": 1, "documents": found}, indent=2, ensure_ascii=False).encode()

    heads = stemmed.groupBy(job).agg(F.array_sort(F.collect_list(order)).alias("documents")).select(F.col(job).cast("string").alias("job"), F.lit(-1).cast("long").alias("seq"), F.lit("manifest.json").alias("path"), manifest("documents").alias("data"))
    payload = F.array(*[F.struct(F.lit(f".{ext}").alias("ext"), (F.col(c) if c == "annotated_pdf" else F.encode(c, "utf-8")).alias("data")) for c, ext in export.PAYLOADS if c in entries.columns])
    one = stemmed.where("status = 'completed'").select(F.col(job).cast("string").alias("job"), F.col("seq").cast("long").alias("seq"), "files", F.explode(payload).alias("p")).where("p.data is not null")
    name = F.get(F.filter("files", lambda f: F.endswith(f, F.col("p.ext"))), F.lit(0))
    return heads.unionByName(one.select("job", "seq", name.alias("path"), "p.data"))


def write_archives(entries: DataFrame, path: str, job: str = "job") -> None:
    """An archive ``<job>.zip`` for each job below a folder. A job's files come to one task, since they are one file; jobs spread over all tasks."""
    spark = entries.sparkSession
    spark.dataSource.register(Archives)
    files = archive_files(entries, job)
    files.repartition("job").sortWithinPartitions("job", "seq", "path").write.format("archives").mode("append").save(path)
