"""Indexing real trees: scanning, incremental refreshes, statistics, purging, streaming."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from codelake.plans import corpora as C
from codelake.plans.index import build_index, index_from_files, open_index, purge, refresh, stats
from codelake.plans.search import search, with_context
from codelake.schemas import RAW_FILES
from codelake.sources.codefiles import list_files, read_repo, with_content
from codelake.sources.reports import markdown_table, read_benchmarks
from codelake.sources.store import IndexStore, Segment

TREE = {
    "src/main.py": b"def main():\n    return 1\n",
    "src/pkg/__init__.py": b"",
    ".eslintrc.json": b"{}\n",
    "crlf.js": b"function a() {}\r\nfunction b() {}\r\n",
    "bad.md": b"a\xff\xfeb\n",
    "nul.py": b"x\x00y",
    "late_nul.py": b"# " + b"a" * 8192 + b"\x00\n",
    "big.py": b"#" * (2 * 1024 * 1024 + 1),
    "limit.py": b"#" * (2 * 1024 * 1024),
    "node_modules/x/y.js": b"function hidden() {}\n",
    "vendor/v.py": b"def vendored(): pass\n",
    "deep/a/b/c/d/e.py": b"class Deep: pass\n",
    "lib.pyc": b"",
    "yarn.lock": b"",
    "Makefile": b"all:\n",
    "_private/x.py": b"def private(): pass\n",
    ".codelakeignore": b"# comment\n\n  vendor  \n*.log\n",
}


def write(root, files):
    for path, content in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    write(root, TREE)
    os.symlink(root / "src", root / "linked")
    return root


INDEXED = {
    "src/main.py", "src/pkg/__init__.py", ".eslintrc.json", "crlf.js", "bad.md", "late_nul.py", "limit.py",
    "deep/a/b/c/d/e.py", "_private/x.py",
}


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_scan(spark, tree, partitions):
    found = read_repo(spark, str(tree), "r", partitions=partitions).collect()
    assert {r.path for r in found} == INDEXED | {"Makefile", ".codelakeignore"}
    for r in found:
        assert bytes(r.content) == TREE[r.path] and r.size_bytes == len(TREE[r.path])
    every = [r.path for r in list_files(spark, str(tree), partitions=partitions).collect()]
    assert sorted(every) == sorted(TREE)


@pytest.mark.parametrize("opened", [1, 7, 5000])
def test_listing_in_rounds(spark, tmp_path, opened):
    """Whatever a round leaves closed: a deep chain, many directories, one full directory, a name that is not UTF-8."""
    files = {f"d{i}/e{j}/f.py": b"#" * i for i in range(9) for j in range(3)}
    files |= {f"full/{i}.md": b"x" for i in range(300)} | {"/".join("abcdefghij") + "/deep.c": b"12345", "ä/ü.py": b""}
    write(tmp_path, files | {"d1/skip/x.py": b""})
    os.makedirs(tmp_path / "empty")
    open(os.path.join(os.fsencode(tmp_path), b"\xff.py"), "wb").close()
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling")
    found = list_files(spark, str(tmp_path), ["skip"], 3, opened=opened).collect()
    assert len(found) == len(files) and {r.path: r.size_bytes for r in found} == {p: len(c) for p, c in files.items()}
    wanted = list_files(spark, str(tmp_path), ["skip"], 3, F.col("path").endswith(".c"), opened)
    assert [(r.path, r.mtime) for r in wanted.collect()] == [
        ("a/b/c/d/e/f/g/h/i/j/deep.c", int(os.stat(tmp_path / "a/b/c/d/e/f/g/h/i/j/deep.c").st_mtime))
    ]
    assert list_files(spark, str(tmp_path / "nothing")).count() == 0


def test_scan_of_nothing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_repo(spark, str(tmp_path / "nowhere"), "r")
    (tmp_path / "file").write_text("x")
    with pytest.raises(ValueError):
        read_repo(spark, str(tmp_path / "file"), "r")


def build(spark, tree, where, **options):
    return build_index(spark, str(tree), str(where), "r", buckets=4, partitions=4, **options)


def paths(spark, where):
    return {r.path for r in open_index(spark, str(where)).files.collect()}


def names(spark, where, text):
    rows = search(open_index(spark, str(where)), C.requests(spark, (text,))).collect()
    return [r.symbol_name for r in rows]


def test_incremental_indexing(spark, tree, tmp_path):
    where = tmp_path / "index"
    first = build(spark, tree, where)
    assert (first["files_scanned"], first["files_new"], first["files_skipped"]) == (11, 9, 2)
    assert first["symbols_extracted"] == 5 and first["chunks_created"] == 9
    assert paths(spark, where) == INDEXED

    again = build(spark, tree, where)
    assert (again["files_unchanged"], again["files_indexed"], again["files_deleted"]) == (9, 0, 0)

    (tree / "src/main.py").write_bytes(b"def mend():\n    return 1\n")  # same length
    (tree / "crlf.js").unlink()
    write(tree, {"new.py": b"import os\n"})
    (tree / "bad.md").rename(tree / "bad.unknown")  # leaves the known languages
    mixed = build(spark, tree, where)
    counts = [mixed[f"files_{c}"] for c in ("new", "updated", "unchanged", "deleted")]
    assert counts == [1, 1, 6, 2]
    assert names(spark, where, "def:main") == [] and names(spark, where, "def:mend") == ["mend"]
    assert names(spark, where, "import:os") == ["os"]
    assert names(spark, where, "def:b") == []

    forced = build(spark, tree, where, force=True)
    assert forced["files_new"] == 8 and forced["files_deleted"] == 0
    index = open_index(spark, str(where))
    assert index.files.count() == 8 and index.symbols.filter("name = 'mend'").count() == 1


def test_two_repositories_do_not_disturb_each_other(spark, tmp_path):
    where = str(tmp_path / "index")
    for repo, name in (("a", "one"), ("b", "two")):
        root = tmp_path / repo
        write(root, {"same.py": f"def {name}(): pass\n".encode()})
        build_index(spark, str(root), where, repo, buckets=2, partitions=2)
    assert names(spark, where, "def:one") == ["one"] and names(spark, where, "def:two") == ["two"]


def raw(spark, snapshot):
    rows = [("r", p, len(t), 1, bytearray(t, "utf-8"), None) for p, t in snapshot.items()]
    return spark.createDataFrame(rows, RAW_FILES)


def everything(index):
    shown = {}
    for name in ("files", "chunks", "symbols", "postings"):
        frame = getattr(index, name)
        columns = [c for c in frame.columns if c not in ("segment", "bucket", "mtime", "content_hash", "n_tokens", "level")]
        shown[name] = sorted(map(str, frame.select(*columns).collect()))
    return shown


def test_incremental_equals_full(spark, tmp_path):
    rng = random.Random(7)

    def text(i):
        return f"class C{i}:\n    def m{rng.randint(0, 3)}(self): pass\n" + "word other\n" * rng.randint(0, 5)

    snapshot = {f"f{i}.py": text(i) for i in range(12)}
    for step in range(3):
        refresh(spark, raw(spark, snapshot), str(tmp_path / "kept"), "r", buckets=4, chunk_lines=3)
        for path in rng.sample(sorted(snapshot), 4):
            if rng.random() < 0.5:
                del snapshot[path]
            else:
                snapshot[path] = text(99)
        snapshot[f"new{step}.py"] = text(step)
    refresh(spark, raw(spark, snapshot), str(tmp_path / "kept"), "r", buckets=4, chunk_lines=3)
    refresh(spark, raw(spark, snapshot), str(tmp_path / "fresh"), "r", buckets=4, chunk_lines=3)
    kept, fresh = (everything(open_index(spark, str(tmp_path / d))) for d in ("kept", "fresh"))
    assert kept == fresh
    assert kept["files"]


def test_a_run_that_dies_counts_for_nothing(spark, tmp_path):
    where = str(tmp_path / "index")
    refresh(spark, raw(spark, {"a.py": "def a(): pass\n"}), where, "r", buckets=2)
    before = everything(open_index(spark, where))
    store = IndexStore(spark, where)
    half = open_index(spark, where).files.withColumn("path", F.lit("ghost.py"))
    store.write("files", half, Segment(store.new_version(), 2, 1))
    assert everything(open_index(spark, where)) == before


def test_stored_search_equals_search_in_plans(spark, files_of, tmp_path):
    texts = {f"d/{i}.py": f"class User{i}:\n    def find_{i}(self): pass\n# the users are found\n" for i in range(9)}
    where = str(tmp_path / "index")
    refresh(spark, raw(spark, texts), where, "r", buckets=4, chunk_lines=2)
    asked = C.requests(spark, ("find", "use*", '"users are"', "class:User", "def:find the", "symbol:_3"), 5, 1)
    stored, plain = open_index(spark, where), index_from_files(files_of(texts), 2)
    found = [
        sorted(map(str, with_context(i, search(i, asked), asked).collect())) for i in (stored, plain)
    ]
    assert found[0] == found[1] and found[0]


def test_statistics_and_purge(spark, tmp_path):
    where = str(tmp_path / "index")
    refresh(spark, raw(spark, {"a.py": "def a(): pass\n", "b.js": "class B {}\n", "c.md": ""}), where, "r", buckets=2)
    row = stats(spark, where).first()
    assert (row.total_files, row.total_symbols) == (3, 2)
    assert row.files_by_language == {"python": 1, "javascript": 1, "markdown": 1}
    assert row.symbols_by_kind == {"function": 1, "class": 1}
    assert row.size_bytes > 0 and row.metadata["schema_version"] == "1.0"
    purge(spark, where)
    index = open_index(spark, where)
    assert index.files.count() == index.chunks.count() == index.symbols.count() == index.postings.count() == 0
    assert search(index, C.requests(spark, ("a", "def:a"))).count() == 0
    refresh(spark, raw(spark, {"a.py": "def a(): pass\n"}), where, "r", buckets=2)
    assert open_index(spark, where).files.count() == 1


def test_corpus_statistics_count_empty_chunks(spark, files_of):
    row = index_from_files(files_of({"a.md": "", "b.md": "one two\n"})).stats.first()
    assert (row.n_chunks, row.n_tokens, row.avgdl) == (2, 2, 1.0)


def test_benchmark_reports(spark, tmp_path):
    saved = [
        {"repo_name": "a", "repo_path": "/a", "repo_size_loc": 12345, "repo_size_mb": 0.1, "file_count": 3,
         "symbol_count": 1000, "index_time_seconds": 0.5, "index_size_mb": 1.25, "query_p50_ms": 0.1,
         "query_p95_ms": 2.0, "query_p99_ms": 3.0},
    ]
    saved.append({**saved[0], "repo_name": "b", "repo_size_loc": 5})
    path = tmp_path / "results.json"
    path.write_text(json.dumps(saved, indent=2))
    lines = {(r.part, r.place): r.line for r in markdown_table(read_benchmarks(spark, str(path))).collect()}
    assert lines["row", "a"] == "| a | 12,345 | 3 | 1,000 | 0.50s | 1.25 MB | 0.10 ms | 2.00 ms |"
    assert lines["average", ""].startswith("| **AVERAGE** | **6,175** | **3** | **1,000** | **0.50s** |")


def test_contents_come_in_batches_of_bounded_bytes(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"f{i:02}.py").write_bytes(b"#" * 100_000)
    rows = with_content(list_files(spark, str(tmp_path), (), 1), str(tmp_path), batch_bytes=250_000).collect()
    assert len(rows) == 60 and all(len(r.content) == r.size_bytes and r.error is None for r in rows)
