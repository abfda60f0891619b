"""One file per record with a sidecar of its metadata, as a data source that commits whole jobs.

`rows.write.format("record_files").option("path", uri).mode("append").save()` writes each row's `content` to
`files/<name>` and its other columns to `metadata/<name>.json`, and a `metadata.csv` per task. Tasks write to folders of
their own attempt below `_staging`; the commit drops attempts that lost and renames the job's folder into place, once. So
files and metadata of a job appear together, a task that was tried again leaves one copy, and a job that failed leaves
nothing. The URI is one that pyarrow's file systems reach from driver and executors; the rename should be atomic there.

Columns: name (string, unique in a job), content (string; null is an empty file), and any others."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "record_files"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    n: int


class RecordWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite = path.rstrip("/"), schema.names, overwrite
        if not {"name", "content"} <= set(self.names):
            raise ValueError("records need the columns name and content")
        self.job = uuid.uuid4().hex

    def _open(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        return system, root, f"{root}/_staging/{self.job}"

    def write(self, iterator: Iterator) -> Attempt:
        system, _, staged = self._open()
        folder = f"part-{uuid.uuid4().hex}"
        for kind in ("files", "metadata"):
            system.create_dir(f"{staged}/{folder}/{kind}", recursive=True)
        table = io.StringIO()
        lines, n = csv.writer(table), 0
        others = [c for c in self.names if c != "content"]
        lines.writerow(others)
        for n, row in enumerate(iterator, 1):
            name = row["name"]
            facts = {c: row[c] for c in others}
            for kind, suffix, text in (("files", "", row["content"] or ""), ("metadata", ".json", json.dumps(facts, ensure_ascii=False, sort_keys=True, default=str))):
                with system.open_output_stream(f"{staged}/{folder}/{kind}/{name}{suffix}") as out:
                    out.write(text.encode("utf-8", "surrogatepass"))
            lines.writerow(["" if facts[c] is None else facts[c] for c in others])
        with system.open_output_stream(f"{staged}/{folder}/metadata.csv") as out:
            out.write(table.getvalue().encode("utf-8", "surrogatepass"))
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        system, root, staged = self._open()
        won = {m.folder for m in messages if m is not None}
        for info in system.get_file_info(fs.FileSelector(staged, allow_not_found=True)):
            if info.base_name not in won:
                system.delete_dir(info.path)
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if self.overwrite else []:
            if info.base_name.startswith("job-"):
                system.delete_dir(info.path)
        if won:
            system.move(staged, f"{root}/job-{self.job}")

    def abort(self, messages: list[Attempt | None]) -> None:
        system, _, staged = self._open()
        from pyarrow import fs

        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordFiles)
