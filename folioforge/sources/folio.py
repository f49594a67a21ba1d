"""Document folders as a data source: spark.read.format("folio"), and readStream.

    spark.dataSource.register(FolioSource)
    spark.read.format("folio").load("s3://bucket/folder").where("extension = '.docx'")

One row for each page of a file that could be read, else one row with the reason. A batch is cut into partitions by bytes, so
that a few large files do not share a task. Conditions on path and extension are applied to the listing: other files are
never opened. Without `text` among the options' columns, files are checked but not parsed. Folders may lie in any store that
pyarrow.fs knows (file, s3, gs, hdfs).
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

SCHEMA = "path string, extension string, length long, sha256 string, error string, page_number int, text string"
#: Bytes of a partition, bytes of a file that is still read, milliseconds a file has to lie still before a stream takes it.
SPLIT_BYTES, MAX_BYTES, SETTLE_MS = 64 << 20, 20 << 20, 1000
_NEEDS_BYTES, _NEEDS_PAGES = {"sha256", "error", "page_number", "text"}, {"error", "page_number", "text"}


@dataclass(frozen=True)
class Found:
    """A file of the listing; `at` are nanoseconds of its last change."""

    path: str
    length: int
    at: int

    @property
    def extension(self) -> str:
        name = self.path.rsplit("/", 1)[-1]
        return f".{name.rsplit('.', 1)[1].lower()}" if "." in name else ""


@dataclass
class Piece(InputPartition):
    files: tuple[Found, ...]


def listing(root: str) -> list[Found]:
    """Files below a folder, by change and path. A folder that is not there is an error."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((Found(i.path, i.size, i.mtime_ns or 0) for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))), key=lambda f: (f.at, f.path))


def cut(files: list[Found], size: int) -> list[Piece]:
    """Files dealt to partitions of about `size` bytes, none of them empty."""
    out: list[list[Found]] = []
    room = 0
    for f in files:
        if not out or room < f.length:
            out.append([])
            room = size
        out[-1].append(f)
        room -= f.length
    return [Piece(tuple(p)) for p in out]


def why_not(name: str, length: int, data: bytes, limit: int) -> str | None:
    """The first check that a file fails, in the order of files.validate."""
    import io
    import zipfile

    if name not in (".pdf", ".docx"):
        return "UNSUPPORTED_EXTENSION"
    if not length:
        return "EMPTY_FILE"
    if length > limit:
        return "FILE_TOO_LARGE"
    if name == ".pdf":
        head, tail = data[:1024], data[-4096:]
        if b"%PDF-" not in head or b"%%EOF" not in tail:
            return "CORRUPT_FILE"
        return "ENCRYPTED_FILE" if b"/Encrypt" in head or b"/Encrypt" in tail else None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            sound = {"[Content_Types].xml", "word/document.xml"} <= set(z.namelist()) and z.testzip() is None
    except Exception:  # any damage
        sound = False
    return None if sound else "CORRUPT_FILE"


def rows_of(root: str, piece: Piece, columns: tuple[str, ...], limit: int) -> Iterator[tuple]:
    from pyarrow import fs

    from folioforge.sources.files import PARSERS

    store, _ = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    for f in piece.files:
        known = {"path": f.path, "extension": f.extension, "length": f.length}
        pages: list[tuple] = [(None, None, None)]
        if _NEEDS_BYTES & set(columns):
            data = b""
            if f.length <= limit:
                with store.open_input_stream(f.path) as s:
                    data = s.read()
                known["sha256"] = hashlib.sha256(data).hexdigest()
            if _NEEDS_PAGES & set(columns):
                error = why_not(f.extension, f.length, data, limit)
                if error is None:
                    try:
                        pages = [(None, k, t) for k, t in enumerate(PARSERS[f.extension](data), 1)]
                    except KeyError:
                        error = "PARSER_PENDING"
                    except Exception as e:
                        error = f"PARSE_FAILED:{type(e).__name__}"
                if error is not None:
                    pages = [(error, None, None)]
        for error, number, text in pages:
            known |= {"error": error, "page_number": number, "text": text}
            yield tuple(known.get(c) for c in columns)


class _Options:
    def __init__(self, options, schema: StructType):
        self.root = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.limit = int(options.get("maxBytes", MAX_BYTES))
        self.settle = int(options.get("settleMs", SETTLE_MS))
        self.columns = tuple(schema.names)


class FolioReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.o = options
        self.only: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on path and extension are settled by the listing; all others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("path", "extension") and isinstance(f, EqualTo | In | StringStartsWith):
                self.only.append((column, f))
            else:
                yield f

    def wanted(self, f: Found) -> bool:
        for column, rule in self.only:
            value = getattr(f, column)
            fits = value == rule.value if isinstance(rule, EqualTo) else value in rule.value if isinstance(rule, In) else value.startswith(rule.value)
            if not fits:
                return False
        return True

    def partitions(self) -> list[Piece]:
        return cut([f for f in listing(self.o.root) if self.wanted(f)], self.o.split) or [Piece(())]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return rows_of(self.o.root, partition, self.o.columns, self.o.limit)


class FolioStream(DataSourceStreamReader):
    """New files by change and path. An offset is the last file taken, so a restart neither loses nor repeats one; a file
    counts only once it has lain still for a while, so that none can still come before one that was taken."""

    def __init__(self, options: _Options):
        self.o = options

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        still = time.time_ns() - self.o.settle * 1_000_000
        done = [f for f in listing(self.o.root) if f.at <= still]
        return {"at": done[-1].at, "path": done[-1].path} if done else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        after, upto = (start["at"], start["path"]), (end["at"], end["path"])
        return cut([f for f in listing(self.o.root) if after < (f.at, f.path) <= upto], self.o.split)

    def read(self, partition: Piece) -> Iterator[tuple]:
        return rows_of(self.o.root, partition, self.o.columns, self.o.limit)


class FolioSource(DataSource):
    """Options: path; splitBytes, maxBytes, settleMs. A schema given to the reader names the columns that are made."""

    @classmethod
    def name(cls) -> str:
        return "folio"

    def schema(self) -> str:
        return SCHEMA

    def _asked(self, schema: StructType) -> _Options:
        unknown = set(schema.names) - {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        return _Options(self.options, schema)

    def reader(self, schema: StructType) -> FolioReader:
        return FolioReader(self._asked(schema))

    def streamReader(self, schema: StructType) -> FolioStream:
        return FolioStream(self._asked(schema))


def register(spark: SparkSession) -> None:
    from folioforge.cluster import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolioSource)
