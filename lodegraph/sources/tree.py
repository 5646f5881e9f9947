"""Source trees as a Spark data source, walked in the tasks.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("slices", 16).load(root)

Each entry of the tree has one owner among the slices, by a hash of its path.  A task walks the top ``levels`` of the
tree, takes the files there that it owns, and goes down into the folders below that it owns.  So neither the names
nor the sizes of files ever reach the driver, one folder with very many files is read by all tasks, and ignored
folders are never entered.  Links are told and never followed.
"""

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders and artefacts that are not part of a repository.
IGNORED_FOLDERS = (
    ".git", ".hg", ".svn", "node_modules", "dist", "build", ".next", ".venv", "venv", "__pycache__", ".cache",
    ".mypy_cache", ".pytest_cache", ".tox", "vendor", "vendors", "generated", "__MACOSX",
)

SCHEMA = "path string, kind string, size bigint, content binary"
#: Bytes of content and rows of a batch.
BATCH_BYTES, BATCH_ROWS = 8_000_000, 5_000


def ignored(name: str) -> bool:
    return name in IGNORED_FOLDERS or name == ".DS_Store" or name.startswith("._")


class LocalTree:
    """Folders of a mounted file system."""

    def __init__(self, root: str):
        self.root = unquote(urlsplit(root).path) if root.startswith("file:") else root

    def entries(self, folder: str) -> Iterator[tuple[str, str, int | None]]:
        with os.scandir(os.path.join(self.root, folder)) as found:
            for entry in found:
                if entry.is_symlink():
                    yield entry.name, "link", None
                elif entry.is_dir():
                    yield entry.name, "folder", None
                elif entry.is_file():
                    yield entry.name, "file", entry.stat().st_size

    def content(self, path: str) -> bytes:
        with open(os.path.join(self.root, path), "rb") as file:
            return file.read()


class RemoteTree:
    """Folders of an object store or HDFS."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(root)

    def entries(self, folder: str) -> Iterator[tuple[str, str, int | None]]:
        from pyarrow import fs

        for entry in self.files.get_file_info(fs.FileSelector(f"{self.root}/{folder}".rstrip("/"))):
            if entry.type == fs.FileType.Directory:
                yield entry.base_name, "folder", None
            elif entry.type == fs.FileType.File:
                yield entry.base_name, "file", entry.size

    def content(self, path: str) -> bytes:
        with self.files.open_input_stream(f"{self.root}/{path}") as file:
            return file.read()


def opened(root: str) -> LocalTree | RemoteTree:
    return LocalTree(root) if "://" not in root or root.startswith("file:") else RemoteTree(root)


@dataclass
class Slice(InputPartition):
    number: int


class TreeReader(DataSourceReader):
    def __init__(self, root: str, slices: int, levels: int, content: bool):
        self.root, self.slices, self.levels, self.content = root, slices, levels, content

    def partitions(self) -> list[Slice]:
        return [Slice(i) for i in range(self.slices)]

    def owned(self, path: str, number: int) -> bool:
        return zlib.crc32(path.encode("utf-8", "surrogateescape")) % self.slices == number

    def walk(self, tree: LocalTree | RemoteTree, number: int) -> Iterator[tuple[str, str, int | None]]:
        """The entries that a slice owns."""
        open_folders: list[tuple[str, int]] = [("", 0)]
        while open_folders:
            folder, level = open_folders.pop()
            for name, kind, size in tree.entries(folder):
                if ignored(name):
                    continue
                path = f"{folder}/{name}".lstrip("/")
                # below the top levels all entries of a folder belong to the slice that went down
                mine = level >= self.levels or self.owned(path, number)
                if kind == "folder" and (mine or level + 1 < self.levels):
                    open_folders.append((path, level + 1))
                if mine:
                    yield path, kind, size

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        tree = opened(self.root)

        def batch() -> pa.RecordBatch:
            cells = list(zip(*rows, strict=True)) or [()] * 4
            kinds = pa.string(), pa.string(), pa.int64(), pa.binary()
            columns = [pa.array(c, k) for c, k in zip(cells, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["path", "kind", "size", "content"])

        for path, kind, size in self.walk(tree, partition.number):
            data = tree.content(path) if self.content and kind == "file" else None
            shown = path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            rows.append((shown, kind, size, data))
            held += len(data or b"")
            if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield batch()
                rows, held = [], 0
        yield batch()


class SourceTree(DataSource):
    """Options: ``path``; ``slices``, the number of tasks; ``levels`` that all tasks list; ``content``, or names only."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        get = self.options.get
        content = get("content", "true").lower() == "true"
        return TreeReader(self.options["path"], int(get("slices", "16")), int(get("levels", "2")), content)
