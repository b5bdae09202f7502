"""`df.write.format("payloads").save(path)`: payloads as files that are named by their content.

A task writes a payload under a name of its own and then renames it to its sha256, so what has a final name is whole, and a task
that is killed or runs twice leaves no partial file and no second copy. Only when all tasks are done does the driver write the job's
manifest, a table of (sha256, size, path) by task in `_manifests/<job>`; a job that fails has none. Names from
mails never become names of files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from mailstruct.sources.eml import opened

STAGING, MANIFESTS = "_staging", "_manifests"


@dataclass
class Written(WriterCommitMessage):
    """A task's list of files, by the name of its own part of the manifest."""

    part: str
    files: int


def place_of(digest: str, suffix: str) -> str:
    """Path below the sink's root: 256 folders, so that none grows too large."""
    return f"{digest[:2]}/{digest}{suffix}"


class PayloadWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        at = {k.lower(): v for k, v in options.items()}
        if "path" not in at:
            raise ValueError("a path is needed")
        self.root, self.suffix, self.job = at["path"].rstrip("/"), at.get("suffix", ""), uuid.uuid4().hex
        self.column = at.get("column", "payload")
        if self.column not in columns:
            raise ValueError(f"no column {self.column}; name the one that holds the bytes by the option column")
        if overwrite:
            raise ValueError("files named by their content are only ever added")

    def write(self, rows: Iterator) -> Written:
        """Rows without payload write nothing."""
        from pyarrow import fs

        store, root = opened(self.root)
        mine = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(mine, recursive=True)
        done: dict[str, int] = {}
        for row in rows:
            data = row[self.column]
            if data is None:
                continue
            data = bytes(data) if not isinstance(data, str) else data.encode()
            digest = hashlib.sha256(data).hexdigest()
            if digest in done:
                continue
            done[digest] = len(data)
            place = f"{root}/{place_of(digest, self.suffix)}"
            if store.get_file_info(place).type == fs.FileType.NotFound:
                with store.open_output_stream(f"{mine}/{digest}") as f:
                    f.write(data)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                store.move(f"{mine}/{digest}", place)
        part = uuid.uuid4().hex
        with store.open_output_stream(f"{mine}/{part}.json") as f:
            for digest, size in done.items():
                f.write((json.dumps({"sha256": digest, "size": size, "path": place_of(digest, self.suffix)}) + "\n").encode())
        return Written(f"{mine}/{part}.json", len(done))

    def commit(self, messages: list[Written | None]) -> None:
        """The tasks' lists become the manifest; lists of attempts that did not count go."""
        store, root = opened(self.root)
        store.create_dir(f"{root}/{MANIFESTS}/{self.job}", recursive=True)
        for m in messages:
            if m is not None:
                store.move(m.part, f"{root}/{MANIFESTS}/{self.job}/{m.part.rpartition('/')[2]}")
        with store.open_output_stream(f"{root}/{MANIFESTS}/{self.job}/_SUCCESS"):
            pass
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.root)
        from pyarrow import fs

        if store.get_file_info(f"{root}/{STAGING}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{STAGING}/{self.job}")


class PayloadSink(DataSource):
    """Options: path, column (payload), suffix of the names (none). Mode append only."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return "payload binary"

    def writer(self, schema, overwrite: bool) -> PayloadWriter:
        return PayloadWriter(dict(self.options), schema.fieldNames(), overwrite)


def manifest(spark, path: str):
    """(sha256, size, path) of all that finished jobs wrote or found there; several jobs may have the same file."""
    return spark.read.schema("sha256 string, size long, path string").json(f"{path}/{MANIFESTS}/*/*.json")
