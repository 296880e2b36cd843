"""A data source that writes one text file for each name, byte for byte.

    files.register(spark)
    files.in_files(rows, "name", "number").write.format("named_text").mode("append").save(folder)

rows have (name, number, line); a file is its lines in order of number, joined by
nothing.  Each task writes its files to a staging folder of its own attempt and
the commit moves the files of the attempts that count to their names, so a
repeated task leaves one file and a failed write none.  A file with a name that
is there is replaced.  A file is one stream of lines in one task, never held whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGING = "_staging"


@dataclass
class Written(WriterCommitMessage):
    """The staged files of a task attempt: (staged path, name)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class NamedTextWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = pafs.FileSystem.from_uri(self.folder)
        place = f"{top}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(place, recursive=True)
        done, out, now = Written(), None, None
        for batch in iterator:
            for name, line in zip(batch.column("name").to_pylist(), batch.column("line").to_pylist()):
                if out is None or name != now:
                    if out is not None:
                        out.close()
                    if not name or "/" in name or name.startswith(("_", ".")):
                        raise ValueError(f"not a file name: {name!r}")
                    now, staged = name, f"{place}/{len(done.files):06d}"
                    out = store.open_output_stream(staged)
                    done.files.append((staged, name))
                out.write((line or "").encode())
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, top = pafs.FileSystem.from_uri(self.folder)
        moves = [move for m in messages if m is not None for move in m.files]
        names = [name for _, name in moves]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("lines of one file came from several tasks: deal rows with in_files")
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda move: store.move(move[0], f"{top}/{move[1]}"), moves))
        self._clear(store, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*pafs.FileSystem.from_uri(self.folder))

    def _clear(self, store: pafs.FileSystem, top: str) -> None:
        place = f"{top}/{STAGING}/{self.job}"
        if store.get_file_info(place).type != pafs.FileType.NotFound:
            store.delete_dir(place)
        if store.get_file_info(f"{top}/{STAGING}").type != pafs.FileType.NotFound and not store.get_file_info(pafs.FileSelector(f"{top}/{STAGING}")):
            store.delete_dir(f"{top}/{STAGING}")


class NamedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_text"

    def schema(self) -> str:
        return "name string, number bigint, line string"

    def writer(self, schema, overwrite: bool) -> NamedTextWriter:
        return NamedTextWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedText)


def in_files(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with the lines of a name together, in order."""
    return rows.repartition("name").sortWithinPartitions("name", *order).select("name", "number", "line")


def save(rows: DataFrame, folder: str) -> None:
    """Write (name, number, line) rows to one file a name."""
    register(rows.sparkSession)
    in_files(rows, "number").write.format("named_text").mode("append").save(folder)
