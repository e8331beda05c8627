"""A data source that looks at the first and last bytes of files without loading them.

``format("probe")`` lists folders in the tasks, one for each folder below the path, and reads four bytes from a file's head and at most
1 KiB from its end. Paths may lie in any store that pyarrow's file systems know.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.text import file_name
from .files import MOST_BYTES

#: Bytes that are read from a file's head and end.
HEAD, END = 4, 1024
#: Files that lie in the path itself, for each task.
FILES_A_TASK = 1000
PROBED = "path string, length long, modified_at timestamp, head binary, tail binary, bytes_read long, error string"


class Folder(InputPartition):
    """A folder with all that is below it, or some files."""

    def __init__(self, folder: str | None, files: tuple[str, ...] = ()):
        self.folder, self.files = folder, files


class ProbeReader(DataSourceReader):
    def __init__(self, path: str, most_bytes: int, least_bytes: int):
        self.path, self.most, self.least = path, most_bytes, least_bytes

    def partitions(self) -> list[Folder]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=False)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        files = [f.path for f in found if f.type == fs.FileType.File]
        return [Folder(f.path) for f in found if f.type == fs.FileType.Directory] + [Folder(None, tuple(files[i : i + FILES_A_TASK])) for i in range(0, len(files), FILES_A_TASK)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for info in self._files(store, partition):
            if not self.least <= info.size <= self.most:
                continue
            try:
                with store.open_input_file(info.path) as file:
                    head = file.read_at(min(HEAD, info.size), 0)
                    tail = file.read_at(min(END, info.size), max(0, info.size - END))
                yield info.path, info.size, info.mtime, head, tail, len(head) + len(tail), None
            except OSError as error:
                yield info.path, info.size, info.mtime, None, None, 0, str(error)[:300]

    def _files(self, store: fs.FileSystem, partition: Folder) -> Iterator[fs.FileInfo]:
        """Folder by folder; one that can't be listed is passed over."""
        if partition.files:
            yield from store.get_file_info(list(partition.files))
            return
        folders = [partition.folder]
        while folders:
            try:
                found = store.get_file_info(fs.FileSelector(folders.pop(), recursive=False))
            except OSError:
                continue
            folders += [f.path for f in found if f.type == fs.FileType.Directory]
            yield from (f for f in found if f.type == fs.FileType.File)


class ProbeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "probe"

    def schema(self) -> str:
        return PROBED

    def reader(self, schema: StructType) -> DataSourceReader:
        return ProbeReader(self.options["path"], int(self.options.get("most_bytes", MOST_BYTES)), int(self.options.get("least_bytes", 0)))


def probe_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, least_bytes: int = 0) -> DataFrame:
    """(path, name, length, modified_at, head, tail, bytes_read, error) of all files below a path, within the size limits.

    A file that can't be opened is a row with its error, and no bytes.
    """
    spark.dataSource.register(ProbeSource)
    probed = spark.read.format("probe").option("most_bytes", most_bytes).option("least_bytes", least_bytes).load(path)
    return probed.select("path", file_name(F.col("path")).alias("name"), "length", "modified_at", "head", "tail", "bytes_read", "error")
