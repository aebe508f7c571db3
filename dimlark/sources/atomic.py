"""A table sink that replaces a table as a whole, or leaves it as it was.

Tasks write files of their own below ``data``. When all of them are done the driver writes one
manifest that names the files, by a rename, under the next number; the manifest with the highest
number is the table. A task that is tried again writes another file, which the manifest names
instead; a job that fails is aborted and what it wrote goes. Readers take the manifest's files, so they
see the earlier table until the rename and the new one from then on. Files that none of the last
``KEPT`` manifests names are removed by the next commit: a reader may finish what it began.

One writer at a time: the sink keeps no lock.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, KEPT = "dimlark_atomic", 2


def uri(path: str) -> str:
    """``path`` as a URI; without a scheme it is a local one."""
    return path.rstrip("/") if re.match(r"[A-Za-z][\w+.-]*:", path) else f"file://{os.path.abspath(path)}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    where, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri(path)))
    return where, at.rstrip("/")


def manifests(where: fs.FileSystem, at: str) -> list[str]:
    """Paths of the manifests, the latest last."""
    found = where.get_file_info(fs.FileSelector(f"{at}/manifests", allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".json"))


def manifest(where: fs.FileSystem, path: str) -> dict:
    with where.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class Wrote(WriterCommitMessage):
    """What a task wrote: a file's name, if it had rows."""

    name: str | None
    rows: int


class AtomicWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema_json, self.job = path, schema.json(), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        where, at = opened(self.path)
        name, out, rows = f"{self.job}-{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if out is None:
                    where.create_dir(f"{at}/data", recursive=True)
                    sink = where.open_output_stream(f"{at}/data/{name}")
                    out = pq.ParquetWriter(sink, batch.schema, compression="zstd")
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
                sink.close()
        return Wrote(name if rows else None, rows)

    def commit(self, messages: list[Wrote | None]) -> None:
        where, at = opened(self.path)
        done = [m for m in messages if m and m.name]
        before = manifests(where, at)
        number = int(before[-1].rpartition("/")[2].removesuffix(".json")) + 1 if before else 1
        where.create_dir(f"{at}/manifests", recursive=True)
        draft = f"{at}/manifests/{self.job}.draft"
        with where.open_output_stream(draft) as f:
            f.write(json.dumps({"files": sorted(m.name for m in done), "rows": sum(m.rows for m in done), "schema": self.schema_json}).encode())
        where.move(draft, f"{at}/manifests/{number:010d}.json")
        self.clear(where, at, manifests(where, at))

    def clear(self, where: fs.FileSystem, at: str, known: list[str]) -> None:
        """Removes what only manifests before the last ``KEPT`` name."""
        keep = {name for path in known[-KEPT:] for name in manifest(where, path)["files"]}
        for path in known[:-KEPT]:
            for name in set(manifest(where, path)["files"]) - keep:
                if where.get_file_info(f"{at}/data/{name}").is_file:
                    where.delete_file(f"{at}/data/{name}")
            where.delete_file(path)

    def abort(self, messages: list[Wrote | None]) -> None:
        """Removes what this job's tasks wrote, told of or not."""
        where, at = opened(self.path)
        for f in where.get_file_info(fs.FileSelector(f"{at}/data", allow_not_found=True)):
            if f.base_name.startswith(f"{self.job}-"):
                where.delete_file(f.path)


class AtomicTable(DataSource):
    """``df.write.format("dimlark_atomic").mode("overwrite").save(path)``; reading goes by ``read_table``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> AtomicWriter:
        if not overwrite:
            raise ValueError("this sink replaces tables; it doesn't append to them")
        return AtomicWriter(self.options["path"], schema)


def write_table(df: DataFrame, path: str) -> None:
    """``df`` in place of what is at ``path``, all or nothing."""
    df.sparkSession.dataSource.register(AtomicTable)
    df.write.format(FORMAT).mode("overwrite").save(path)


def has_table(path: str) -> bool:
    return bool(manifests(*opened(path)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as its latest manifest has it."""
    where, at = opened(path)
    known = manifests(where, at)
    if not known:
        raise FileNotFoundError(f"no table at {path}")
    told = manifest(where, known[-1])
    schema = StructType.fromJson(json.loads(told["schema"]))
    files = [f"{uri(path)}/data/{name}" for name in told["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
