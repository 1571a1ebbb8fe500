import pytest
from pyspark.sql import functions as F

from plumbline.session import scratch
from plumbline.sources import repository
from plumbline.sources.store import KeyedStore


def tree(root, files):
    for path, content in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_repository_scan(spark, tmp_path):
    root = tmp_path / "re[p]o {x}"
    tree(root, {
        "a.py": "print(1)", "src/app/b.ts": "é", "src/app/c.min.js": "x", "src/d.PNG": b"\x89", "yarn.lock": "x", "src/Cargo.lock": "x", "big.md": "x" * 50,
        "node_modules/m/x.js": "x", "node_modules/y.js": "x", "src/node_modules/z/w.js": "x", ".git/HEAD": "x", "docs/bad.md": b"\xff\xfeok", "docs/build/x.html": "x", "empty.css": "", "src/_app.tsx": "x", ".env": "x", "_lib/x.py": "y",
    })
    scan = repository.scan(spark, str(root), most=40)
    rows = {r["path"]: (r["length"], r["text"], r["language"]) for r in scan.files.collect()}
    assert set(rows) == {"a.py", "src/app/b.ts", "docs/bad.md", "empty.css", "_lib/x.py"}
    assert rows["src/app/b.ts"][:2] == (2, "é") and rows["docs/bad.md"][1].endswith("ok")
    assert scan.skipped() == {"suffix:.min.js": 1, "suffix:.png": 1, "file:yarn.lock": 1, "file:Cargo.lock": 1, "size": 1, "hidden": 2, "dir:node_modules": 3, "dir:.git": 1, "dir:build": 1}
    assert scan.included() == 5


def test_repository_scan_of_given_folders(spark):
    scan = repository.scan(spark, "/root/testdata/sf0.001", most=10**9)
    assert {r["path"] for r in scan.files.select("path").collect()} >= {"documents.parquet", "pages.parquet"} and scan.skipped() == {}


def store(spark, buckets=8):
    rows = spark.createDataFrame([(k, f"v{k}", k % 3) for k in range(50)] + [(None, "none", 9)], "id long, value string, part int")
    own = KeyedStore(spark, scratch(spark, "store"), ["id"], rows.schema, buckets)
    own.merge(rows)
    return own


def values(own):
    return {r["id"]: r["value"] for r in own.read().collect()}


def test_merge_and_delete_rewrite_only_what_changes(spark):
    own = store(spark)
    want = {k: f"v{k}" for k in range(50)} | {None: "none"}
    assert values(own) == want
    _, before = own.manifest()
    own.merge(spark.createDataFrame([(7, "new", 1), (7, "newer", 1), (None, "still none", 0)], own.schema))
    want |= {7: "newer", None: "still none"}
    version, after = own.manifest()
    assert values(own) == want and version == 2
    changed = {b for b in before if before[b] != after[b]}
    assert 1 <= len(changed) <= 2
    own.delete((F.col("id") > 40) & (F.col("part") == 1))
    want = {k: v for k, v in want.items() if k is None or not (k > 40 and k % 3 == 1)}
    assert values(own) == want
    own.delete(F.col("value") == "nothing")
    own.merge(spark.createDataFrame([], own.schema))
    assert own.manifest()[0] == 3
    own.delete(F.lit(True))
    assert values(own) == {} and own.manifest()[0] == 4
    own.merge(spark.createDataFrame([(1, "again", 0)], own.schema))
    assert values(own) == {1: "again"}


def test_failed_write_leaves_the_version(spark):
    own = store(spark)
    before = values(own), own.manifest()
    fail = F.udf(lambda x: 1 // 0, "string")
    with pytest.raises(Exception):
        own.merge(spark.createDataFrame([(1, "x", 0)], own.schema).withColumn("value", fail("value")))
    assert (values(own), own.manifest()) == before


def test_only_one_writer_publishes_a_version(spark):
    own = store(spark)
    version, folders = own.manifest()
    own.merge(spark.createDataFrame([(1, "x", 0)], own.schema))
    with pytest.raises(Exception):
        own._publish(version, folders, set(), own._read({}))
    assert values(own)[1] == "x"
