"""Mail files as tables and streams: `format("mail")` gives files, `format("eml")` their part rows. No file is listed by name twice.

    register(spark)
    scan(spark, "hdfs://host/mails", max_size=1_000_000, path_like="*/2024/*")
    spark.readStream.format("mail").option("settleSeconds", "5").load("s3://bucket/mails")

Files are listed and opened by their store's own client (local, HDFS, S3, GCS, ABFS), once by the driver for their names, sizes and
times, and by tasks for their bytes. Small files share a partition. Options minSize, maxSize, pathLike, modifiedAfter and
modifiedBefore decide before any file is opened, for tables and streams. With the option pushdown, conditions of where() on path, size, time
and id do as well; but Spark 4.1.2 keeps what one query has pushed for all queries of the same frame, which then lose rows, so it is off
unless asked for, and a frame with it serves one query.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatchcase

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains,
    StringEndsWith, StringStartsWith,
)

from mailstruct.sources.mime import PARTS, email_rows

FILES = "email_id long, path string, modified timestamp, size long"
#: Bytes that a partition holds, what opening a file counts for, and names of mail files.
PARTITION_BYTES, OPEN_BYTES, PATTERN = 64 << 20, 64 << 10, "*.eml"
PART_NAMES = ["email_id", "error", "layer_seq", "layer_depth", "parent_layer_seq", "via_attachment", "via_mime_type", "signature", "headers", "part_seq", "content_type", "filename", "content_id", "is_attachment", "own", "multipart", "att_idx", "image_idx", "has_markup", "text", "payload"]


@dataclass(frozen=True)
class MailFile:
    """A file as listed. path is its URI as Spark writes it."""

    path: str
    size: int
    modified: int

    @property
    def email_id(self) -> int:
        """Spark's xxhash64 of the path: the same file has the same id in every batch, stream and in sources.requests.from_files."""
        import xxhash

        n = xxhash.xxh64_intdigest(self.path.encode(), 42)
        return n - (1 << 64) if n >> 63 else n

    @property
    def time(self) -> datetime:
        return datetime.fromtimestamp(self.modified // 1000 / 1_000_000, UTC)

    def read(self) -> bytes:
        store, path = opened(self.path)
        with store.open_input_stream(path) as f:
            return f.read()

    def order(self) -> tuple[int, str]:
        return self.modified, self.path


@dataclass
class Pack(InputPartition):
    files: list[MailFile]


def opened(uri: str):
    """(store, path in it). A local path may be written plainly or as file:/..."""
    from pyarrow import fs

    if uri.startswith("file:/"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def listed(root: str, pattern: str = PATTERN) -> list[MailFile]:
    """The files at or below a path whose names match one of the patterns, by path. A path that doesn't exist is an error."""
    from pyarrow import fs

    store, base = opened(root)
    found = store.get_file_info(base)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
    local = isinstance(store, fs.LocalFileSystem)
    head = "file:" if local else root[: root.index(base.lstrip("/").split("/")[0])]
    hidden = lambda path: any(part[:1] in "._" for part in path[len(base) :].split("/") if part)
    named = lambda name: any(fnmatchcase(name, p.strip()) for p in pattern.split(","))
    out = [MailFile(head + (i.path if local else i.path.lstrip("/")), i.size, i.mtime_ns or 0) for i in infos if i.type == fs.FileType.File and named(i.base_name) and not hidden(i.path)]
    return sorted(out, key=lambda f: f.path)


def packed(files: Iterable[MailFile], most: int = PARTITION_BYTES) -> list[Pack]:
    """Files in order, as many to a partition as most bytes allow; a larger file has one of its own."""
    out: list[Pack] = []
    held = most
    for f in files:
        if held + f.size + OPEN_BYTES > most:
            out.append(Pack([]))
            held = 0
        out[-1].files.append(f)
        held += f.size + OPEN_BYTES
    return out


def known(condition: Filter) -> bool:
    """Whether a condition can be decided by what is listed."""
    if isinstance(condition, Not):
        return known(condition.child)
    kinds = (EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith)
    return isinstance(condition, kinds) and condition.attribute in (("path",), ("size",), ("modified",), ("email_id",))


def holds(condition: Filter, f: MailFile) -> bool:
    if isinstance(condition, Not):
        return not holds(condition.child, f)
    if isinstance(condition, IsNotNull):
        return True
    mine, value = {"path": f.path, "size": f.size, "modified": f.time, "email_id": f.email_id}[condition.attribute[0]], condition.value
    if isinstance(mine, datetime) and isinstance(value, datetime) and value.tzinfo is None:
        value = value.astimezone(UTC)
    match condition:
        case EqualTo() | EqualNullSafe():
            return mine == value
        case In():
            return mine in value
        case GreaterThan():
            return mine > value
        case GreaterThanOrEqual():
            return mine >= value
        case LessThan():
            return mine < value
        case LessThanOrEqual():
            return mine <= value
        case StringContains():
            return value in mine
        case StringStartsWith():
            return mine.startswith(value)
        case _:
            return mine.endswith(value)


class Options:
    def __init__(self, options: dict):
        at = {k.lower(): v for k, v in options.items()}
        if "path" not in at:
            raise ValueError("a path is needed")
        self.path, self.pattern = at["path"], at.get("pathglobfilter", PATTERN)
        self.partition_bytes = int(at.get("partitionbytes", PARTITION_BYTES))
        self.with_content = at.get("content", "true").lower() == "true"
        self.settle = float(at.get("settleseconds", 0))
        self.most = int(at.get("maxfilespertrigger", 0))
        self.max_depth, self.pushdown = int(at.get("maxdepth", 10)), at.get("pushdown", "false").lower() == "true"
        number = lambda name, none: float(at.get(name, none))
        self.sizes, self.like = (number("minsize", 0), number("maxsize", "inf")), at.get("pathlike", "*")
        moment = lambda name: datetime.fromisoformat(at[name]).timestamp() * 1e9 if name in at else None
        self.after, self.before = moment("modifiedafter"), moment("modifiedbefore")

    def files(self) -> list[MailFile]:
        """What is listed and wanted, by path."""
        low, high = self.sizes
        timely = lambda f: (self.after is None or f.modified >= self.after) and (self.before is None or f.modified < self.before)
        return [f for f in listed(self.path, self.pattern) if low <= f.size <= high and timely(f) and fnmatchcase(f.path, self.like)]


def file_row(f: MailFile, options: Options) -> tuple:
    return (f.email_id, f.path, f.time, f.size, *([f.read()] if options.with_content else []))


def part_tuples(f: MailFile, options: Options) -> Iterator[tuple]:
    at = PART_NAMES.index("headers")
    for row in email_rows(f.email_id, f.read(), options.max_depth):
        values = [row.get(n) for n in PART_NAMES]
        values[at] = None if values[at] is None else [(h["k"], h["v"]) for h in values[at]]
        yield tuple(values)


class MailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.conditions = Options(options), []

    def partitions(self) -> list[Pack]:
        files = [f for f in self.options.files() if all(holds(c, f) for c in self.conditions)]
        return packed(files, self.options.partition_bytes)

    def read(self, partition: Pack) -> Iterator[tuple]:
        for f in partition.files if partition else ():
            yield file_row(f, self.options)


class PushedReader(MailReader):
    """Takes the conditions that a listing decides. Needs spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if known(f):
                self.conditions.append(f)
            else:
                yield f


class PartReader(DataSourceReader):
    """Part rows; a mail's id is all that can be decided before it is parsed, so nothing is pushed here."""

    def __init__(self, options: dict):
        self.options = Options(options)

    def partitions(self) -> list[Pack]:
        return packed(self.options.files(), self.options.partition_bytes)

    def read(self, partition: Pack) -> Iterator[tuple]:
        for f in partition.files if partition else ():
            yield from part_tuples(f, self.options)


class MailStream(DataSourceStreamReader):
    """New files as new rows, by (time, path): an offset is the last file of a batch, and a batch what lies between two offsets.

    Files younger than settleSeconds wait, so one whose time is a little older than the last seen still counts if it shows by then. A file
    that is moved in later with an older time is not seen. Files must not change once they are there.
    """

    def __init__(self, options: dict):
        self.options = Options(options)
        self.last = self.initialOffset()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"modified": -1, "path": ""}

    def between(self, start: dict, end: dict | None) -> list[MailFile]:
        """Files after start, and not after end, in order of time."""
        low = (start["modified"], start["path"])
        high = (end["modified"], end["path"]) if end else (time.time_ns() - int(self.options.settle * 1e9), "")
        return sorted((f for f in self.options.files() if low < f.order() and (f.order() <= high if end else f.modified <= high[0])), key=MailFile.order)

    def latestOffset(self) -> dict:  # noqa: N802
        new = self.between(self.last, None)
        if self.options.most:
            new = new[: self.options.most]
        if new:
            self.last = {"modified": new[-1].modified, "path": new[-1].path}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        self.last = max(self.last, end, key=lambda o: (o["modified"], o["path"]))
        return packed(self.between(start, end), self.options.partition_bytes)

    def read(self, partition: Pack) -> Iterator[tuple]:
        for f in partition.files if partition else ():
            yield file_row(f, self.options)

    def commit(self, end: dict) -> None:
        pass


class PartStream(MailStream):
    def read(self, partition: Pack) -> Iterator[tuple]:
        for f in partition.files if partition else ():
            yield from part_tuples(f, self.options)


class MailDataSource(DataSource):
    """(email_id, path, modified, size, content) of mail files; option content=false leaves out the bytes, and opens no file."""

    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> str:
        return FILES + (", content binary" if Options(dict(self.options)).with_content else "")

    def reader(self, schema) -> MailReader:
        options = dict(self.options)
        return (PushedReader if Options(options).pushdown else MailReader)(options)

    def streamReader(self, schema) -> MailStream:  # noqa: N802
        return MailStream(dict(self.options))


class EmlDataSource(DataSource):
    """Part rows of mail files."""

    @classmethod
    def name(cls) -> str:
        return "eml"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema) -> PartReader:
        return PartReader(dict(self.options))

    def streamReader(self, schema) -> PartStream:  # noqa: N802
        return PartStream(dict(self.options))




def register(spark) -> None:
    """Makes both formats known to the session."""
    for source in (MailDataSource, EmlDataSource):
        spark.dataSource.register(source)


def scan(spark, path: str, *, min_size: int | None = None, max_size: int | None = None, path_like: str | None = None, modified_after: str | None = None, modified_before: str | None = None, **options):
    """A table of mail files. Sizes are bytes, both ends included; path_like has * and ?; times are ISO 8601, the first included."""
    given = {"minSize": min_size, "maxSize": max_size, "pathLike": path_like, "modifiedAfter": modified_after, "modifiedBefore": modified_before, **options}
    register(spark)
    return spark.read.format("mail").options(**{k: v for k, v in given.items() if v is not None}).load(path)
