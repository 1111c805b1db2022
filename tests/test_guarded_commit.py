"""Guarded scans (links, swaps, sizes, filters) and publication in two phases (races, failures, recovery)."""

import contextlib
import os
import threading
import types

import pytest
from pyspark.sql import functions as F

from foliospark.sinks import commit
from foliospark.sources import guarded


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for name, text in {"a.md": "one", "b/c.PDF": "two", "b/d/e.pdf": "", "b/skip/x.pdf": "no", ".hidden/y.pdf": "no", "b/.z.pdf": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "o.pdf").write_text("secret")
    (root / "b" / "link.pdf").symlink_to(tmp_path / "outside" / "o.pdf")
    (root / "linked").symlink_to(tmp_path / "outside")
    os.mkfifo(root / "b" / "pipe.pdf")
    return root


def rows_of(found):
    return sorted((r["path"], r["size"], None if r["content"] is None else bytes(r["content"]), r["problem"]) for r in found.collect())


def test_scan_follows_no_link(spark, tree):
    found = rows_of(guarded.guarded_files(spark, f"file://{tree}", skip="skip"))
    assert [r for r in found if r[0] in ("a.md", "b/c.PDF", "b/d/e.pdf")] == [("a.md", 3, b"one", None), ("b/c.PDF", 3, b"two", None), ("b/d/e.pdf", 0, b"", None)]
    assert [(p, c, x) for p, _, c, x in found if x] == [("b/link.pdf", None, "symlink"), ("b/pipe.pdf", None, "not a regular file"), ("linked", None, "symlink")] and len(found) == 6


def test_scan_options_and_filters(spark, tree):
    pdfs = guarded.guarded_files(spark, str(tree), suffixes="pdf", skip="skip", maxBytes="2", content="false")
    assert [(p, x) for p, _, _, x in rows_of(pdfs)] == [("b/c.PDF", "too large"), ("b/d/e.pdf", None), ("b/link.pdf", "symlink"), ("b/pipe.pdf", "not a regular file")]
    mixed = guarded.guarded_files(spark, f"{tree}/a.md;{tree}/b/d")
    assert [r[0] for r in rows_of(mixed)] == ["a.md", "e.pdf"]
    assert [r[0] for r in rows_of(guarded.guarded_files(spark, str(tree)).where("path like 'b/d/%'"))] == ["b/d/e.pdf"]
    assert [r[0] for r in rows_of(guarded.guarded_files(spark, str(tree)).where(F.col("path").isin("a.md", "b/c.PDF", "nope")))] == ["a.md", "b/c.PDF"]
    reader = guarded.GuardedReader({"path": str(tree)})
    list(reader.pushFilters([guarded.StringStartsWith(("path",), "b/d")]))
    assert [p.paths for p in reader.partitions()] == [["b/d/e.pdf"]] and not reader.wanted("linked", True)


def test_folder_swapped_for_a_link(tree, tmp_path):
    reader = guarded.GuardedReader({"path": str(tree)})
    parts = reader.partitions()
    (tree / "b" / "d").rename(tmp_path / "away")
    (tree / "b" / "d").symlink_to(tmp_path / "outside")
    found = [r for part in parts for batch in reader.read(part) for r in batch.to_pylist() if r["path"] == "b/d/e.pdf"]
    assert [(r["content"], r["problem"]) for r in found] in ([(None, "NotADirectoryError")], [(None, "symlink")])


def test_file_changed_while_read(tree, monkeypatch):
    real, seen = os.fstat, []

    def grown(handle):
        if not seen:
            seen.append(1)
            result = real(handle)
            (tree / "a.md").write_text("one more")
            return result
        return real(handle)

    monkeypatch.setattr(guarded.os, "fstat", grown)
    root = os.open(tree, os.O_RDONLY)
    try:
        assert guarded.bounded_bytes(root, "a.md", 100)[2] == "changed"
    finally:
        os.close(root)


def test_roots_that_are_refused(tree, tmp_path):
    (tmp_path / "r").symlink_to(tree)
    for path in (str(tmp_path / "r"), str(tmp_path / "none")):
        with pytest.raises((ValueError, FileNotFoundError)):
            guarded.GuardedReader({"path": path}).partitions()
    with pytest.raises(ValueError, match="path"):
        guarded.GuardedReader({})


def states(found):
    return sorted((r["path"], r["state"]) for r in found.collect())


def files(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


def test_publish_states(spark, tmp_path):
    root, n = tmp_path / "out", iter(range(100))
    put = lambda rows, **k: states(commit.publish(spark.createDataFrame(rows, "path string, text string, expected string"), f"file://{root}", f"file://{tmp_path}/s{next(n)}", **k))
    digest = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    assert put([("a", "1", None), ("d/b", "2", None), ("../x", "3", None), ("c", None, None), ("e", "5", None), ("e", "6", None)]) == [("../x", "refused"), ("a", "written"), ("c", "empty"), ("d/b", "written"), ("e", "repeated"), ("e", "written")]
    assert files(root) == {"a": "1", "d/b": "2", "e": "6"}
    assert put([("a", "1", None), ("d/b", "3", digest("2")), ("e", "7", digest("5")), ("n", "8", digest(""))]) == [("a", "unchanged"), ("d/b", "written"), ("e", "conflict"), ("n", "written")]
    assert put([("a", "9", None), ("m", "9", None)], create_only=True) == [("a", "exists"), ("m", "written")]
    assert put([("a", "0", digest("1")), ("e", "0", digest("no"))], together=True) == [("a", "held"), ("e", "conflict")]
    assert files(root) == {"a": "1", "d/b": "3", "e": "6", "n": "8", "m": "9"}


def test_two_writers(spark, tmp_path):
    root, outcomes = tmp_path / "out", []

    def write(k):
        rows = spark.createDataFrame([(f"f{n}", f"{k} {n}") for n in range(40)], "path string, text string")
        try:
            outcomes.append((k, {s for _, s in states(commit.publish(rows, f"file://{root}", f"file://{tmp_path}/w{k}"))}))
        except commit.Busy:
            outcomes.append((k, "busy"))

    writers = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    kept = files(root)
    assert len(kept) == 40 and len({t.split()[0] for t in kept.values()}) == 1 and len(outcomes) == 2
    winner = int(next(iter(kept.values())).split()[0])
    assert dict(outcomes)[winner] == {"written"} and dict(outcomes)[1 - winner] in ("busy", {"conflict"}, {"written"})


def test_failed_and_repeated_tasks(spark, tmp_path):
    root = tmp_path / "out"
    commit.publish(spark.createDataFrame([("a", "old")], "path string, text string"), f"file://{root}", f"file://{tmp_path}/s0")
    bad = spark.range(50).select(F.concat(F.lit("f"), "id").alias("path"), F.when(F.col("id") == 49, F.raise_error(F.lit("broken"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="broken"):
        commit.publish(bad, f"file://{root}", f"file://{tmp_path}/s1")
    assert files(root) == {"a": "old"}
    stage = commit._stager(f"file://{root}", ".folio-w")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"path": "b", "content": b"new", "expected": None, "create_only": False, "nth": 1}])
    first, second = (next(stage(iter([batch]))).to_pylist() for _ in range(2))
    assert first[0]["staged"] != second[0]["staged"]
    move = commit._publisher(f"file://{root}")
    listed = pa.RecordBatch.from_pylist(second)
    assert [next(move(iter([listed]))).to_pylist()[0]["state"] for _ in range(2)] == ["written", "written"]
    assert (root / "b").read_text() == "new"


class Watched:
    """A local store that counts its folders' making and knows which files are open to be read."""

    def __init__(self, store):
        self.store, self.open, self.made, self.moved = store, set(), [], []

    def __getattr__(self, name):
        return getattr(self.store, name)

    def create_dir(self, path, recursive):
        self.made.append(path)
        self.store.create_dir(path, recursive=recursive)

    @contextlib.contextmanager
    def open_input_stream(self, path):
        self.open.add(path)
        with self.store.open_input_stream(path) as source:
            yield source
        self.open.remove(path)

    def move(self, source, target):
        self.moved.append((target, target in self.open, os.path.exists(target)))
        self.store.move(source, target)


def test_replaced_files_are_open_until_they_are_moved_over_and_folders_made_once(tmp_path, monkeypatch):
    import pyarrow as pa

    pfs, watched, states_of, root = commit.pfs, [], [], tmp_path / "out"

    def from_uri(uri):
        watched.append(Watched(pfs.LocalFileSystem()))
        return watched[-1], uri.removeprefix("file://")

    monkeypatch.setattr(commit, "pfs", types.SimpleNamespace(FileSystem=types.SimpleNamespace(from_uri=from_uri), FileType=pfs.FileType))
    for text in (b"old", b"new"):
        asked = [{"path": f"{'a' if k < 5 else 'b'}/{k}", "content": text, "expected": None, "create_only": False, "nth": 1} for k in range(10)]
        staged = list(commit._stager(f"file://{root}", ".folio-w")(iter([pa.RecordBatch.from_pylist(asked[:4]), pa.RecordBatch.from_pylist(asked[4:])])))
        states_of.append([r["state"] for b in commit._publisher(f"file://{root}")(iter(staged)) for r in b.to_pylist()])
    assert states_of == [["written"] * 10] * 2 and files(root) == {f"{'a' if k < 5 else 'b'}/{k}": "new" for k in range(10)}
    stager, mover, again, replacing = watched
    assert len(stager.made) == len(again.made) == 1 and mover.made == [f"{root}/a", f"{root}/b"] and replacing.made == []
    assert [(held, there) for _, held, there in mover.moved] == [(False, False)] * 10
    assert [(held, there) for _, held, there in replacing.moved] == [(True, True)] * 10 and not replacing.open


def test_driver_that_dies(spark, tmp_path, monkeypatch):
    root = tmp_path / "out"
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, text string")
    monkeypatch.setattr(commit, "_finish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        commit.publish(rows, f"file://{root}", f"file://{tmp_path}/s1")
    monkeypatch.undo()
    with pytest.raises(commit.Busy):
        commit.publish(rows, f"file://{root}", f"file://{tmp_path}/s2")
    assert states(commit.recover(spark, f"file://{root}", f"file://{tmp_path}/s3")) == [("a", "written"), ("b", "written")]
    assert files(root) == {"a": "1", "b": "2"} and commit.recover(spark, f"file://{root}", f"file://{tmp_path}/s4") is None
