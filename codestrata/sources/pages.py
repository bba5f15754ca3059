"""A sink of one file for each row: a Spark data source that publishes pages only when all of them are there.

    spark.dataSource.register(PagesSource)
    pages.write.format("pages").mode("overwrite").save("/shared/site")  # columns rel_path, html

A task attempt writes its pages under a name of its own, in a folder beside the target, with a list of them at the end. Only the
commit, after all tasks, brings the pages of the attempts that Spark counts together, and puts the folder in the target's place in
one step; pages of failed or repeated attempts are never looked at. An abort removes the folder and leaves the target as it was.

The target is a path or a URI of any store that pyarrow reaches and that driver and executors share. Where a store renames folders (POSIX
disks, HDFS), the old site goes as the new one comes; in object stores pages are put in place one by one, those at the top last, and then
old pages go. With ``overwrite`` the site is replaced; else pages are added to it, and one that is there already is an error, as is a page
that two rows name, a null, and a path that leads out of the site.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Pages moved at a time by the commit.
MOVERS = 32
#: The list of an attempt's pages.
LIST = "_pages.jsonl"


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    """The store and the path inside it of a URI or local path."""
    return stores.FileSystem.from_uri(path if "://" in path else str(Path(path).absolute()))


def exists(store: stores.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != stores.FileType.NotFound


def renames_folders(store: stores.FileSystem) -> bool:
    return store.type_name in ("local", "hdfs")


@dataclass
class Written(WriterCommitMessage):
    """What a task attempt tells the commit."""

    attempt: str
    pages: int


class PagesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _folders(self) -> tuple[stores.FileSystem, str, str]:
        """The store, the target, and this run's folder beside it."""
        store, target = store_of(self.path)
        return store, target, posixpath.join(posixpath.dirname(target), f".{posixpath.basename(target)}-{self.run}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        store, _, stage = self._folders()
        attempt = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        folder, made, count = f"{stage}/attempts/{attempt}", set(), 0
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{LIST}") as listed:
            for batch in iterator:
                for rel_path, html in zip(batch.column("rel_path").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    if rel_path is None or html is None or posixpath.isabs(rel_path) or posixpath.normpath(rel_path) != rel_path or rel_path.startswith("..") or rel_path == LIST:
                        raise ValueError(f"not a page of the site: {rel_path!r}")
                    path = f"{folder}/{rel_path}"
                    if (parent := posixpath.dirname(path)) not in made:
                        store.create_dir(parent, recursive=True)
                        made.add(parent)
                    if count and exists(store, path):
                        raise ValueError(f"two rows name the page {rel_path!r}")
                    with store.open_output_stream(path) as out:
                        out.write(html.encode())
                    listed.write(json.dumps(rel_path).encode() + b"\n")
                    count += 1
        return Written(attempt, count)

    def commit(self, messages: list[Written | None]) -> None:
        store, target, stage = self._folders()
        site = f"{stage}/site" if self.overwrite or not exists(store, target) else target
        store.create_dir(site, recursive=True)
        for message in messages:
            if message:
                gather(store, f"{stage}/attempts/{message.attempt}", site, message.pages)
        if site != target:
            publish(store, site, target, stage)
        store.delete_dir(stage)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, stage = self._folders()
        if exists(store, stage):
            store.delete_dir(stage)


def _listed(store: stores.FileSystem, folder: str) -> list[str]:
    if not exists(store, f"{folder}/{LIST}"):
        raise FileNotFoundError(f"{folder} is not there: the site's folder must be one that driver and executors share")
    with store.open_input_stream(f"{folder}/{LIST}") as f:
        return [json.loads(line) for line in f.read().splitlines()]


def _each(pages: Iterable[str], do) -> None:
    with ThreadPoolExecutor(MOVERS) as pool:
        for _ in pool.map(do, pages):
            pass


def gather(store: stores.FileSystem, folder: str, site: str, pages: int) -> None:
    """Moves an attempt's pages into the site."""
    names = _listed(store, folder)
    if len(names) != pages:
        raise ValueError(f"{folder} has {len(names)} pages, not {pages}")
    for parent in {posixpath.dirname(n) for n in names}:
        store.create_dir(posixpath.join(site, parent), recursive=True)

    def move(name: str) -> None:
        if exists(store, f"{site}/{name}"):
            raise FileExistsError(f"two rows name the page {name!r}")
        store.move(f"{folder}/{name}", f"{site}/{name}")

    _each(names, move)


def publish(store: stores.FileSystem, site: str, target: str, stage: str) -> None:
    """Puts a whole site in the target's place."""
    if renames_folders(store):
        if exists(store, target):
            store.move(target, f"{stage}/old")
        store.move(site, target)
        return
    files = lambda folder: {f.path[len(folder) + 1 :] for f in store.get_file_info(stores.FileSelector(folder, recursive=True, allow_not_found=True)) if f.type == stores.FileType.File}
    new, old = files(site), files(target)
    for parent in {posixpath.dirname(n) for n in new}:
        store.create_dir(posixpath.join(target, parent), recursive=True)
    for top in (False, True):
        _each(sorted(n for n in new if ("/" not in n) == top), lambda n: store.copy_file(f"{site}/{n}", f"{target}/{n}"))
    _each(sorted(old - new), lambda n: store.delete_file(f"{target}/{n}"))


class PagesSource(DataSource):
    """Format ``pages``: rows of ``rel_path`` and ``html`` as files."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def writer(self, schema: StructType, overwrite: bool) -> PagesWriter:
        if missing := {"rel_path", "html"} - {*schema.names}:
            raise ValueError(f"pages need the columns {', '.join(sorted(missing))}")
        return PagesWriter(self.options["path"], overwrite)


def write_pages(pages, path: str, mode: str = "overwrite") -> None:
    """Writes rows of ``rel_path`` and ``html`` by the data source."""
    pages.sparkSession.dataSource.register(PagesSource)
    pages.select("rel_path", "html").write.format("pages").mode(mode).save(path)
