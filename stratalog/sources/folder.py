"""A folder of documents as a Spark data source, and a sink that writes files.

``spark.read.format("stratalog_blocks").load(folder)`` gives the blocks of every readable file below a folder, with
locators and byte offsets into the file's rendition.  The folder is listed once; files are dealt to partitions of about
``partitionBytes`` bytes, and every task opens its own files.  Names that hold secrets or say nothing, and types
without a parser, are left out, or with ``skipped`` set to true give a row with the reason in ``error``; a file that can't
be read always gives such a row.

``df.write.format("stratalog_files").mode("append").save(folder)`` writes a file for each row (path, content); a row
that is written again, by a task that is repeated, replaces its file.
"""

from __future__ import annotations

import hashlib
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from stratalog.functions.phrases import NOISE_NAMES, SECRET_ENDINGS, SECRET_NAMES
from stratalog.operators.graph import keep
from stratalog.sources.files import BLOCKS, KINDS, parse

PARTITION_BYTES = 32 << 20
#: Blocks handed to Spark at once.
BATCH = 4096


def skipped(name: str, size: int) -> str | None:
    """Why a file is not opened, by its name and size alone; None if it is."""
    low = name.lower()
    if low in SECRET_NAMES or low.endswith(SECRET_ENDINGS):
        return "secret"
    if name.startswith(("~$", ".")) or low in NOISE_NAMES:
        return "noise"
    if not size:
        return "empty"
    return None if low.rpartition(".")[2] in KINDS and "." in low else "unsupported"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def known(path: str) -> bool:
    """Whether tasks can list and open what is there; some stores are only known to Spark's readers."""
    try:
        return bool(open_folder(path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime) of the files below a folder, paths as Spark writes them; no file is opened.

    A round lists the folders of one depth, each in one task, and leaves its files and the folders below in the
    checkpoint folder; the driver sees neither.  Left out are files of no bytes and hidden names, as by Spark's readers.
    """
    root = root.rstrip("/")
    inside = open_folder(root)[1].rstrip("/")
    shown = root if "://" in root and not root.startswith("file:") else f"file:{inside}"
    kinds = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", tz="UTC"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = open_folder(root)[0]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = [f for f in system.get_file_info(fs.FileSelector(inside + path)) if not hidden(f.base_name) and (f.type == fs.FileType.Directory or f.size)]
                for k in range(0, len(found), BATCH):
                    part = found[k : k + BATCH]
                    sizes = [None if f.type == fs.FileType.Directory else f.size for f in part]
                    yield pa.RecordBatch.from_arrays([pa.array([f.path[len(inside) :] for f in part]), pa.array(sizes, pa.int64()), pa.array([f.mtime_ns // 1000 for f in part], kinds.field(2).type)], schema=kinds)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, out = spark.createDataFrame([("",)], "path string"), None
    while out is None or not level.isEmpty():
        met = keep(level.repartition(tasks).mapInArrow(run, "path string, length long, modificationTime timestamp"))
        files = met.where("length is not null")
        out, level = files if out is None else out.unionByName(files), met.where("length is null").select("path")
    return out.withColumn("path", F.concat(F.lit(shown), "path"))


def hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


@dataclass
class Files(InputPartition):
    """Files of one task: path below the folder, and why it isn't opened, if so."""

    names: list[tuple[str, str | None]]


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.skipped = str(options.get("skipped", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        system, root = open_folder(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        out, size = [[]], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            reason = skipped(f.base_name, f.size)
            if reason and not self.skipped:
                continue
            if out[-1] and not reason and size + f.size > self.most:
                out.append([])
                size = 0
            out[-1].append((f.path[len(root) :].lstrip("/"), reason))
            size += 0 if reason else f.size
        return [Files(names) for names in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(self.root)
        kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(c, kinds[t]) for c, t in (x.split() for x in BLOCKS.split(", "))])
        rows: list[dict] = []
        for path, reason in partition.names:
            if reason:
                rows.append({"path": path, "error": reason})
            else:
                with system.open_input_stream(f"{root.rstrip('/')}/{path}", compression=None) as f:
                    raw = f.read()
                one = {"path": path, "id": "doc:" + hashlib.sha256(raw).hexdigest()[:16]}
                try:
                    rows += [one | b for b in parse(path.rpartition("/")[2], raw).blocks]
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ET.ParseError, zlib.error) as e:
                    rows.append(one | {"error": str(e)})
            if len(rows) >= BATCH:
                yield from pa.Table.from_pylist(rows, schema=schema).to_batches()
                rows = []
        yield from pa.Table.from_pylist(rows, schema=schema).to_batches()


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stratalog_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator) -> Written:
        system, root = open_folder(self.root)
        n, made = 0, set()
        for row in iterator:
            path = row["path"]
            if path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"not below the folder: {path}")
            target = f"{root.rstrip('/')}/{path}"
            if (folder := target.rpartition("/")[0]) not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            # whole or not at all, whoever reads or writes it at the same time
            part = f"{folder}/.{uuid.uuid4().hex}"
            content = row["content"]
            with system.open_output_stream(part, compression=None) as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content))
            system.move(part, target)
            n += 1
        return Written(n)

    def commit(self, messages: list) -> None:
        """The folder is there even if no row came."""
        system, root = open_folder(self.root)
        system.create_dir(root, recursive=True)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stratalog_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    for source in (BlockSource, FileSink):
        spark.dataSource.register(source)
    return spark


def read_blocks(spark: SparkSession, folder: str, **options) -> DataFrame:
    return register(spark).read.format("stratalog_blocks").options(**options).load(folder)


def write_files(files: DataFrame, folder: str) -> None:
    """A file below ``folder`` for each row (path, content)."""
    register(files.sparkSession)
    files.select("path", files["content"].cast("binary").alias("content")).write.format("stratalog_files").mode("append").save(folder)
