"""Registries in binary files and databases, as data sources that Spark reads in parts and writes in parts.

``quirelight_records``: files of records of one length, little-endian and without a head. Journals are 8 bytes, the hash
of a name; words are 20, the hash of a word and three counts of 32 bits. An incomplete last record is left out.
``quirelight_database``: SQLite databases with a table ``doidata`` of six columns, in this order: hash of the title,
length and upper hash half of two authors, DOI.

Paths are files or folders on any file system that Arrow knows. Records are read by byte ranges; a database on a mounted file
system by ranges of row ids, elsewhere whole in one task, so that such databases should be small parts, as the
writer makes them. Written parts appear under their names when all tasks are done; a task that is run again leaves nothing behind.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quirelight.functions.hashed import key_of_hash, signed_hash_of
from quirelight.sources.registries import journal_set, word_counts

RECORDS, DATABASE = "quirelight_records", "quirelight_database"
#: Bytes and rows of a part that one task reads, records and rows of a database handed on at once, rows of a database that is written.
SPLIT_BYTES, SPLIT_ROWS, BATCH_ROWS, FETCHED_ROWS, FILE_ROWS = 32 << 20, 1 << 20, 1 << 16, 1 << 13, 1 << 18
#: Layouts of records, table and columns of the database.
LAYOUTS = {"journals": [("hash", "<i8")], "words": [("hash", "<i8"), ("a", "<u4"), ("b", "<u4"), ("c", "<u4")]}
TABLE = "doidata"
COLUMNS = {"title_hash": "long", "author1_len": "long", "author1_hash": "long", "author2_len": "long", "author2_hash": "long", "doi": "string"}


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of the files of a folder in order of their names; hidden ones are left out."""
    system, place = _located(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(place, info.size)]
    found = [i for i in system.get_file_info(fs.FileSelector(place)) if i.type == fs.FileType.File and i.base_name[0] not in "._"]
    return [(i.path, i.size) for i in sorted(found, key=lambda i: i.path)]


@dataclass
class Part(InputPartition):
    """Records or row ids from ``start`` up to ``end`` of a file, which is the ``number``-th; a database that is read
    whole has no bounds."""

    number: int
    file: str
    start: int | None = None
    end: int | None = None


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _PartsWriter(DataSourceArrowWriter):
    """Each task writes hidden files of its own, which get their names when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def bodies(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        """Each file's bytes."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, place = _located(self.options["path"])
        system.create_dir(place, recursive=True)
        part, mark, files = TaskContext.get().partitionId(), uuid.uuid4().hex, []
        for n, body in enumerate(self.bodies(iterator)):
            name = f"part-{part:06d}-{n:06d}-{mark}"
            files.append((f"{place}/_{name}", f"{place}/{name}"))
            with system.open_output_stream(files[-1][0]) as out:
                out.write(body)
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        system, place = _located(self.options["path"])
        if self.overwrite and system.get_file_info(place).type == fs.FileType.Directory:
            for file, _ in _files(self.options["path"]):
                system.delete_file(file)
        for hidden, name in (pair for m in messages if m for pair in m.files):
            system.move(hidden, name)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = _located(self.options["path"])
        for hidden, _ in (pair for m in messages if m for pair in m.files):
            system.delete_file(hidden)


class _RecordsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.layout = options, np.dtype(LAYOUTS[options["kind"]])

    def partitions(self) -> list[Part]:
        step = max(1, int(self.options.get("splitbytes", SPLIT_BYTES)) // self.layout.itemsize)
        return [Part(n, f, i, min(i + step, size // self.layout.itemsize)) for n, (f, size) in enumerate(_files(self.options["path"])) for i in range(0, size // self.layout.itemsize, step)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        system, _ = _located(self.options["path"])
        size = self.layout.itemsize
        with system.open_input_file(partition.file) as body:
            for start in range(partition.start, partition.end, BATCH_ROWS):
                rows = np.frombuffer(body.read_at(size * (min(start + BATCH_ROWS, partition.end) - start), size * start), self.layout)
                yield pa.RecordBatch.from_arrays([pa.array(rows[c].astype("<i8")) for c in self.layout.names], list(self.layout.names))


class _RecordsWriter(_PartsWriter):
    def bodies(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        layout = np.dtype(LAYOUTS[self.options["kind"]])
        for batch in batches:
            rows = np.zeros(batch.num_rows, layout)
            for c in layout.names:
                rows[c] = batch.column(c).to_numpy(zero_copy_only=False)
            if batch.num_rows:
                yield rows.tobytes()


class RecordFiles(DataSource):
    """Options: ``path``, ``kind`` (journals or words), ``splitBytes``. Columns: ``hash`` and the counts, as longs."""

    @classmethod
    def name(cls) -> str:
        return RECORDS

    def schema(self) -> str:
        return ", ".join(f"{c} long" for c, _ in LAYOUTS[self.options["kind"]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _RecordsReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _RecordsWriter(self.options, overwrite)


def _asked(options: dict) -> list[str]:
    return [c.strip() for c in options["columns"].split(",")] if options.get("columns") else list(COLUMNS)


class _DatabaseReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.columns = options, _asked(options)

    def _opened(self, file: str) -> sqlite3.Connection:
        system, _ = _located(self.options["path"])
        if isinstance(system, fs.LocalFileSystem):
            return sqlite3.connect(f"file:{file.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)
        database = sqlite3.connect(":memory:")
        with system.open_input_file(file) as body:
            database.deserialize(body.read())
        return database

    def partitions(self) -> list[Part]:
        system, _ = _located(self.options["path"])
        step, out = int(self.options.get("splitrows", SPLIT_ROWS)), []
        for n, (file, _) in enumerate(_files(self.options["path"])):
            if not isinstance(system, fs.LocalFileSystem):
                out.append(Part(n, file))
                continue
            database = self._opened(file)
            first, last = database.execute(f"SELECT min(rowid), max(rowid) FROM {TABLE}").fetchone()
            database.close()
            out += [Part(n, file, i, i + step) for i in range(first, last + 1, step)] if first is not None else []
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        database = self._opened(partition.file)
        # Columns count by their place; names may differ.
        places = dict(zip(COLUMNS, (r[1] for r in database.execute(f"PRAGMA table_info({TABLE})"))))
        named = ", ".join('"' + places[c].replace('"', '""') + '"' for c in self.columns)
        within, bounds = ("", ()) if partition.start is None else (" WHERE rowid >= ? AND rowid < ?", (partition.start, partition.end))
        rows = database.execute(f"SELECT rowid, {named} FROM {TABLE}{within} ORDER BY rowid", bounds)
        while got := rows.fetchmany(FETCHED_ROWS):
            ids, *values = zip(*got)
            arrays = [pa.array(v, pa.string() if COLUMNS[c] == "string" else pa.int64()) for c, v in zip(self.columns, values)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([(partition.number << 40) + i for i in ids], pa.int64())], [*self.columns, "ord"])
        database.close()


class _DatabaseWriter(_PartsWriter):
    def bodies(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS)))
        held = True
        while held:
            database, held = sqlite3.connect(":memory:"), 0
            database.execute(f"CREATE TABLE {TABLE} ({', '.join(c + (' TEXT' if t == 'string' else ' INTEGER') for c, t in COLUMNS.items())})")
            for row, _ in zip(rows, range(FILE_ROWS)):
                database.execute(f"INSERT INTO {TABLE} VALUES (?, ?, ?, ?, ?, ?)", row)
                held += 1
            for c in ("title_hash", "doi"):
                database.execute(f"CREATE INDEX by_{c} ON {TABLE} ({c})")
            database.commit()
            if held:
                yield database.serialize()
            database.close()


class TitleDatabases(DataSource):
    """Options: ``path``, ``columns`` (only these are read), ``splitRows``. Columns: those of the table, and ``ord``, their order."""

    @classmethod
    def name(cls) -> str:
        return DATABASE

    def schema(self) -> str:
        return ", ".join(f"{c} {COLUMNS[c]}" for c in _asked(self.options)) + ", ord long"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _DatabaseReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _DatabaseWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for source in (RecordFiles, TitleDatabases):
        spark.dataSource.register(source)


def _read(spark: SparkSession, form: str, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(form).options(**options).load(path)


def _write(df: DataFrame, form: str, path: str, **options: str) -> None:
    register(df.sparkSession)
    df.write.format(form).options(**options).mode("overwrite").save(path)


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """``name_key`` of a file of journals, see ``functions.hashed``."""
    return journal_set(_read(spark, RECORDS, path, kind="journals").select(key_of_hash(F.col("hash")).alias("name_key")))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``word_key, a, b, c`` of a file of words; counts of records with one hash add up."""
    return word_counts(_read(spark, RECORDS, path, kind="words").select(key_of_hash(F.col("hash")).alias("word_key"), "a", "b", "c"))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """``title_key, author1_len, author1_hash, author2_len, author2_hash, doi, ord`` of databases. Lengths count in 8
    bits and hashes in 32, as the format has them."""
    rows = _read(spark, DATABASE, path)
    part = lambda c, bits: F.col(c).bitwiseAND((1 << bits) - 1).alias(c)
    return rows.select(key_of_hash(F.col("title_hash")).alias("title_key"), *(part(f"author{n}_{c}", bits) for n in (1, 2) for c, bits in (("len", 8), ("hash", 32))), "doi", "ord")


def read_dois(spark: SparkSession, path: str) -> DataFrame:
    """``doi`` of databases; no other column is read."""
    return _read(spark, DATABASE, path, columns="doi").select("doi")


def write_journals(names: DataFrame, path: str) -> None:
    """``name_key``, normalised names, as records."""
    _write(names.where("name_key IS NOT NULL").select(signed_hash_of(F.col("name_key")).alias("hash")), RECORDS, path, kind="journals")


def write_words(words: DataFrame, path: str) -> None:
    """``word_key, a, b, c`` as records. Counts beyond 32 bits do not fit and are refused."""
    fits = lambda c: F.when(F.col(c).between(0, (1 << 32) - 1), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} does not fit: "), F.col(c).cast("string")))).cast("long")
    _write(words.where("word_key IS NOT NULL").select(signed_hash_of(F.col("word_key")).alias("hash"), *(fits(c).alias(c) for c in "abc")), RECORDS, path, kind="words")


def write_titles(titles: DataFrame, path: str, parts: int | None = None) -> None:
    """A registry of texts (see ``registries.read_titles``) as databases in order of title and ``ord``, so
    that a title with very many entries spreads over tasks and entries keep their order; DOIs without a title too; an author's text of more than 255 bytes does not fit and is left out."""
    length = lambda c: F.when(F.octet_length(c) < 256, F.octet_length(c)).otherwise(0).cast("long")
    top = lambda c: F.shiftrightunsigned(signed_hash_of(F.col(c)), 32)
    order = ("title_key", "ord", "doi")
    dealt = (titles.repartitionByRange(parts, *order) if parts else titles.repartitionByRange(*order)).sortWithinPartitions(*order)
    fields = [F.coalesce(f(f"author{n}_key"), F.lit(0).cast("long")).alias(f"author{n}_{c}") for n in (1, 2) for c, f in (("len", length), ("hash", top))]
    _write(dealt.select(signed_hash_of(F.col("title_key")).alias("title_hash"), *fields, "doi"), DATABASE, path)
