"""The tree data source against a plain walk."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.sources import inventory, tree


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Nested, empty, hidden, ignored and linked entries, odd names, and one folder with most files."""
    root, rng = tmp_path_factory.mktemp("tree"), random.Random(1)
    names = [f"many/f{i}.txt" for i in range(400)] + [
        "a.py", ".env", "_config.yml", "empty.txt", "src/b.py", "src/deep/er/still/c.py", "src/deep/._c.py",
        "src/node_modules/x.js", "build/y", "src/deep/er/build/z", "name with space+plus%41.txt", "é/日本.txt", ".DS_Store",
        "src/vendor", "x/.git/config", "x/y/z/w/v/u.txt",
    ]
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if "empty" in name else rng.randbytes(rng.randrange(60)))
    (root / "nothing/here").mkdir(parents=True)
    os.symlink(root / "a.py", root / "src/link.py")
    os.symlink(root, root / "src/loop")
    os.symlink("/nowhere", root / "broken")
    return str(root)


def plain(root):
    out = []
    for at, folders, files in os.walk(root, followlinks=False):
        links = [n for n in folders + files if os.path.islink(os.path.join(at, n)) and not tree.ignored(n)]
        folders[:] = [n for n in folders if not tree.ignored(n) and n not in links]
        files = [n for n in files if not tree.ignored(n) and n not in links]
        for kind, names in (("link", links), ("folder", folders), ("file", files)):
            for name in names:
                path = os.path.join(at, name)
                data = open(path, "rb").read() if kind == "file" else None
                out.append((os.path.relpath(path, root), kind, len(data) if kind == "file" else None, data))
    return sorted(out)


def rows(df):
    return sorted((r["path"], r["kind"], r["size"], None if r["content"] is None else bytes(r["content"])) for r in df.collect())


@pytest.mark.parametrize("levels", [1, 2, 3, 9])
def test_same_as_a_walk(spark, folder, levels):
    """Every entry has one owner, however many levels all tasks list."""
    assert rows(inventory.tree_entries(spark, folder, levels=levels)) == plain(folder)


def test_uri_and_names_only(spark, folder):
    found = inventory.tree_entries(spark, f"file://{folder}", content=False)
    assert rows(found) == [(p, k, s, None) for p, k, s, _ in plain(folder)]


def test_another_file_system(spark, folder):
    """The same walk through Arrow's file systems, which follow links themselves."""
    reader = tree.TreeReader(folder, 3, 2, True)

    class Far(tree.RemoteTree):
        def __init__(self, root):
            from pyarrow import fs

            self.files, self.root = fs.SubTreeFileSystem(root, fs.LocalFileSystem()), ""

    far = Far(os.path.join(folder, "many"))
    assert sorted(far.entries("")) == sorted((f"f{i}.txt", "file", os.path.getsize(f"{folder}/many/f{i}.txt")) for i in range(400))
    owners = [sorted(p for p, *_ in reader.walk(far, i)) for i in range(3)]
    assert sum(map(len, owners)) == 400 and all(len(o) > 80 for o in owners)


def test_a_large_folder_is_spread(spark, folder):
    """Files of one folder are read by several tasks."""
    files = inventory.scan_tree(spark, folder).where("path LIKE 'many/%'")
    sizes = [r["n"] for r in files.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 400 and max(sizes) < 200


def test_the_plan_holds_no_names(spark, folder):
    text = inventory.scan_tree(spark, folder)._jdf.queryExecution().toString()
    assert "f123.txt" not in text and "LocalTableScan" not in text


def test_empty_tree(spark, tmp_path):
    assert inventory.scan_tree(spark, str(tmp_path)).collect() == []


def test_missing_tree(spark, tmp_path):
    with pytest.raises(Exception, match="No such file"):
        inventory.scan_tree(spark, str(tmp_path / "gone")).collect()
