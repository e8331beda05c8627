"""Files, archives and their entries as tables.

Archives are read where Spark puts them; one that can't be read becomes a row that says so, and the rest go on.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_archive_name
from ..functions.text import file_name, fold

MOST_BYTES = 512 * 2**20
MOST_ENTRY_BYTES = 4 * 2**20
# Endings of text resources.
TEXT_NAMES = r"\.(json|txt|cfg|conf|properties|yml|yaml|toml|xml|md|js|lua|py|sh|bat|ps1)$"
ENTRIES = "path string, container string, depth int, ordinal int, name string, flags int, method int, csize long, usize long, header_offset long, crc long, content binary, error string"


def scan_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, content: bool = False) -> DataFrame:
    """(path, name, length, modified_at[, content]) of all files below a path; the size limit reaches the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= most_bytes)
    return files.select("path", file_name(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("modified_at"), *(["content"] if content else []))


def by_extension(files: DataFrame) -> DataFrame:
    return files.where(is_archive_name(F.col("name")))


def disguised(files: DataFrame) -> DataFrame:
    """Files that look like archives inside and not by name; by their content, or by head and tail as ``probe_files`` gives them."""
    probed = "head" in files.columns
    head, end = (F.hex("head"), F.hex("tail")) if probed else (F.hex(F.substring("content", 1, 4)), F.hex(F.substring("content", -1024, 1024)))
    looks = (head == "504B0304") | end.rlike("^(..)*504B0506")
    return files.where((F.col("length") >= 1024) & ~is_archive_name(F.col("name")) & ~fold(F.col("name")).rlike(r"\.jmod$")).where(looks)


def explode_archives(files: DataFrame, depth: int = 2) -> DataFrame:
    """One row for each entry of each archive in (path, content), nested ones down to ``depth``; deeper ones stay unopened.

    The content of entries of up to 4 MiB comes along. An archive that can't be read gives one row with its error.
    """
    def rows(path: str, container: str, level: int, data: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                for i, e in enumerate(archive.infolist()):
                    content, error = None, None
                    nested = e.filename.lower().endswith((".jar", ".war", ".ear", ".aar", ".zip"))
                    if not e.is_dir() and e.file_size <= (MOST_BYTES if nested and level < depth else MOST_ENTRY_BYTES):
                        try:
                            content = archive.read(e)
                        except Exception as x:  # a broken entry is a finding, not an end
                            error = f"{type(x).__name__}: {x}"
                    yield path, container, level, i, e.filename, e.flag_bits, e.compress_type, e.compress_size, e.file_size, e.header_offset, e.CRC, content if content is None or len(content) <= MOST_ENTRY_BYTES else None, error
                    if nested and content is not None and level < depth:
                        yield from rows(path, f"{container}!{e.filename}" if container else e.filename, level + 1, content)
        except Exception as x:
            yield path, container, level, None, None, None, None, None, None, None, None, None, f"{type(x).__name__}: {x}"

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRIES.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                held, size = [], 0
                for row in rows(path, "", 0, bytes(content)):
                    held.append(row)
                    size += len(row[11] or b"")
                    if size > 16 * 2**20:
                        yield pd.DataFrame(held, columns=names).astype({c: "Int64" for c in names[2:4] + names[5:11]})
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names).astype({c: "Int64" for c in names[2:4] + names[5:11]})

    # One large archive is one row, so files are dealt out evenly first.
    return files.select("path", "content").repartition("path").mapInPandas(explode, ENTRIES)


def text_surfaces(entries: DataFrame) -> DataFrame:
    """Text resources of up to 4 MiB as surfaces."""
    texts = entries.where(fold(F.col("name")).rlike(TEXT_NAMES) & (F.col("usize") <= MOST_ENTRY_BYTES) & F.col("content").isNotNull())
    return texts.select("path", "name", F.lit("STRING").alias("surface"), F.lit("RESOURCE").alias("source"), F.decode("content", "UTF-8").alias("text"))
