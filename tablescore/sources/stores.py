"""Data sources of the harness: named files as a sink, and recorded answers as a store that is read by family and stem.

Files are reached through pyarrow, in whatever store it knows (file, hdfs, s3, gs). Tasks write, not the
driver: each attempt writes below a staging folder of its job, and what the job's commit sees through is
moved into place file by file; a job that fails leaves what was there before.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only on a single machine whose session names no spark.checkpoint.dir.
LOCAL = "/tmp/checkpoints"
#: Rows that a reader yields at a time.
ROWS = 1_000
PAYLOAD = T.StructType([*(T.StructField(n, T.StringType()) for n in ("stem", "family", "model", "payload", "status")), T.StructField("seconds", T.DoubleType())])
#: Files into which the answers of a family are dealt by stem.
BUCKETS = 16


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir. Where none is named, a single
    machine gets one; a cluster raises, as its executors share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    return f"{(named or LOCAL).rstrip('/')}/files-{uuid.uuid4().hex}"


def delete(folder: str) -> None:
    fs, at = pfs.FileSystem.from_uri(folder)
    if fs.get_file_info(at).type == pfs.FileType.Directory:
        fs.delete_dir(at)


def materialised(df: DataFrame, folder: str) -> DataFrame:
    """df with its rows in a reliable checkpoint, so that folder, from which they came, can be deleted at once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder.rsplit("/", 1)[0])
    out = df.checkpoint(eager=True)
    delete(folder)
    return out


class Staged(D.WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class NamedFileWriter(D.DataSourceArrowWriter):
    """Rows (file, content) of a task, those of one file next to each other, into files of these names."""

    def __init__(self, path: str, separator: bytes, whole: str | None):
        self.path, self.separator, self.whole, self.job = path, separator, whole, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, top = pfs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{top}/{self.job}")
        files: list[tuple[str, str]] = []
        out = None
        for batch in iterator:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                if not files or files[-1][1] != name:
                    if out:
                        out.close()
                    files.append((f"{self.job}/{uuid.uuid4().hex}", name))
                    out = fs.open_output_stream(f"{top}/{files[-1][0]}", compression=None, buffer_size=1 << 16)
                out.write((content.as_py() or b"") + self.separator)
        if out:
            out.close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, top = pfs.FileSystem.from_uri(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one file are in more than one task or apart in one")
        for folder in {name.rpartition("/")[0] for name in names if "/" in name}:
            fs.create_dir(f"{top}/{folder}")
        for staged, name in files:
            fs.move(f"{top}/{staged}", f"{top}/{name}")
        if self.whole:
            unit = lambda name: m[1] if (m := re.fullmatch(self.whole, name)) else None
            units = {unit(name) for name in names} - {None}
            for name in set(file_names(self.path)) - set(names):
                if unit(name) in units:
                    fs.delete_file(f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        delete(f"{self.path}/{self.job}")


class NamedFiles(D.DataSource):
    """format("named_files"): writes (file string, content binary); a file has its rows, with the option separator after each.
    Files of the same names are replaced, others stay. The option whole is a pattern of names whose first group tells
    what is replaced as a whole: of what gets a file, the files right in the folder that this job has not written go."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> NamedFileWriter:
        return NamedFileWriter(self.options["path"].rstrip("/"), self.options.get("separator", "").encode(), self.options.get("whole"))


def write_files(rows: DataFrame, path: str, separator: str = "", whole: str | None = None) -> None:
    """rows (file, content), of which those of one file are neighbours in one partition. Null contents are empty."""
    rows.sparkSession.dataSource.register(NamedFiles)
    writer = rows.select("file", F.col("content").cast("binary").alias("content")).write.format("named_files").option("separator", separator)
    (writer if whole is None else writer.option("whole", whole)).mode("append").save(path)


def file_names(path: str) -> list[str]:
    """Names of the files right in path."""
    fs, top = pfs.FileSystem.from_uri(path)
    return [f.base_name for f in fs.get_file_info(pfs.FileSelector(top, allow_not_found=True)) if f.type == pfs.FileType.File]


def bucket_of(stem: str) -> int:
    return zlib.crc32(stem.encode()) % BUCKETS


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Recorded answers (PAYLOAD) into a store: JSON lines in files for each family and bucket of stems; files of the families
    and buckets that payloads has are replaced."""
    bucket = F.pmod(F.crc32(F.coalesce("stem", F.lit("")).cast("binary")), F.lit(BUCKETS))
    rows = payloads.select(F.format_string("%s/%02d.jsonl", "family", bucket).alias("file"), F.to_json(F.struct(*PAYLOAD.names)).alias("content"))
    write_files(rows.repartition("file").sortWithinPartitions("file"), path, "\n")


class PayloadFile(D.InputPartition):
    def __init__(self, file: str):
        self.file = file


class PayloadReader(D.DataSourceReader):
    """One partition for each file."""

    def __init__(self, path: str, families: set[str] | None, stems: set[str] | None):
        self.path, self.families, self.stems = path, families, stems

    def partitions(self) -> Sequence[PayloadFile]:
        fs, top = pfs.FileSystem.from_uri(self.path)
        found = []
        for f in fs.get_file_info(pfs.FileSelector(top, recursive=True, allow_not_found=True)):
            family, _, name = f.path.removeprefix(top.rstrip("/") + "/").rpartition("/")
            if f.type != pfs.FileType.File or not name.endswith(".jsonl") or family.startswith("_"):
                continue
            if (self.families is None or family in self.families) and (self.stems is None or any(bucket_of(s) == int(name[:-6]) for s in self.stems)):
                found.append(PayloadFile(f.path))
        return sorted(found, key=lambda p: p.file) or [PayloadFile("")]

    def read(self, partition: PayloadFile) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = pfs.FileSystem.from_uri(self.path)
        schema = pa.schema([(f.name, pa.float64() if f.dataType == T.DoubleType() else pa.string()) for f in PAYLOAD])
        rows: list[dict] = []
        with fs.open_input_stream(partition.file, compression=None, buffer_size=1 << 20) as file:
            for line in io.TextIOWrapper(file, encoding="utf-8", newline="\n"):
                rows.append(json.loads(line))
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class Payloads(D.DataSource):
    """format("payloads"): reads what write_payloads() has written. The options families and stems (JSON lists) pick the folders,
    and the files that may hold a stem. They are options, as Spark keeps the filters that such a source has taken for
    later scans of the same DataFrame without them."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> T.StructType:
        return PAYLOAD

    def reader(self, schema: T.StructType) -> PayloadReader:
        chosen = lambda name: set(json.loads(self.options[name])) if name in self.options else None
        return PayloadReader(self.options["path"].rstrip("/"), chosen("families"), chosen("stems"))


def read_payloads(spark: SparkSession, path: str, families: Sequence[str] | None = None, stems: Sequence[str] | None = None) -> DataFrame:
    """Recorded answers of a store: all, or those of these families and stems, of which only their partitions are read."""
    spark.dataSource.register(Payloads)
    chosen = {k: json.dumps(list(v)) for k, v in (("families", families), ("stems", stems)) if v is not None}
    found = spark.read.format("payloads").options(**chosen).load(path)
    return found if stems is None else found.where(F.col("stem").isin(list(stems)))


def is_store(path: str) -> bool:
    """Whether a folder has what write_payloads() writes."""
    fs, top = pfs.FileSystem.from_uri(path)
    if fs.get_file_info(top).type != pfs.FileType.Directory:
        return False
    return any(f.type == pfs.FileType.File and f.extension == "jsonl" for f in fs.get_file_info(pfs.FileSelector(top, recursive=True)))


class Ledger:
    """Answers of paid calls by key, each a file of its own that is there as soon as the call is over.

    A task that is run again finds what it has been answered and repeats at most the call that it died in. Two
    attempts at a time may both call; the last answer stays. Keys are hashed, and their text is checked.
    """

    def __init__(self, path: str):
        self.path, self.fs = path.rstrip("/"), None

    def place(self, key: str) -> str:
        if self.fs is None:
            self.fs, self.top = pfs.FileSystem.from_uri(self.path)
        name = hashlib.sha256(key.encode()).hexdigest()
        return f"{self.top}/{name[:2]}/{name}.json"

    def get(self, key: str) -> dict | None:
        at = self.place(key)
        try:
            with self.fs.open_input_stream(at, compression=None) as f:
                found = json.loads(f.read())
        except FileNotFoundError:
            return None
        return found["answer"] if found["key"] == key else None

    def put(self, key: str, answer: dict) -> None:
        at = self.place(key)
        self.fs.create_dir(at.rpartition("/")[0])
        with self.fs.open_output_stream(new := f"{at}.{uuid.uuid4().hex}", compression=None) as f:
            f.write(json.dumps({"key": key, "answer": answer}).encode())
        self.fs.move(new, at)

    def __getstate__(self) -> dict:
        return {"path": self.path, "fs": None}
