"""Golden vectors, properties and behaviour of the snapshot engine."""

from __future__ import annotations

import hashlib
import os
import random
import stat

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from merkleframe import queries
from merkleframe.functions import hashing
from merkleframe.functions.blake3 import Span, blake3, blake3_stream, combine
from merkleframe.functions.hashing import digest, register
from merkleframe.operators import algebra, catalog, incremental, integrity, merkle, objects
from merkleframe.plans.workflows import CheckoutError, Workspace, id_of, manifest_of, manifest_with_memo, memo_id, text_of
from merkleframe.schema import parse_text
from merkleframe.sources import fstree, packs, stores
from merkleframe.sources.fstree import FsTree, scan
from merkleframe.sources.stores import ArrowStore, LocalStore, open_store, register_store, shard

NESTED = {"a/a1f": "a1f", "a/aa/aa1f": "aa1f", "a/aa/aaa/aaa1f": "aaa1f", "a/aa/aaa/aaa2f": "aaa2f", "b/bb/bbb/bbb1f": "bbb1f", "b/bb/bbb/bbb2f": "bbb2f", "c/cc/ccc/ccc1f": "ccc1f", "r1f": "r1f"}
# fixed values: root checksums of the tree above
NESTED_ROOTS = {
    ("blake3", None): "207d090daf06217a0920593ee642a90fcad85b9dccec02725e85311005f64327",
    ("md5", None): "3d2919213b827d03a840f2f4f10b650f",
    ("sha256", None): "cccc00189fbf090fad108d378e1edc31b36e6310ea9259ee652d66bc8b87f3ff",
    ("blake3", "secret"): "b64e60321e94894fe9e23522c527a9326521389944198910a3801987c2ab1a19",
    ("md5", "secret"): "3d2919213b827d03a840f2f4f10b650f",
}
# fixed values: root checksums of the tree without a/
NESTED_WITHOUT_A = {
    "blake3": "5f6e000c90cec184fce4c0b959961b368ce7137ccbb86aac67ab4a0a15c5563c",
    "md5": "8a53d475db5cbe669dc2ffce5df06ef3",
    "sha256": "99d921d4212e7c00925ec42cc178385f2d2ab1efece5cf9a11ed7a91ca0e712f",
}


def grow(root, files: dict[str, str], end: str = "\n"):
    """The tree of the files, with modes 600 and 700."""
    os.makedirs(root, exist_ok=True)
    os.chmod(root, 0o700)
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text + end if text else "")
        path.chmod(0o600)
        for folder in path.parents:
            if folder == root:
                break
            folder.chmod(0o700)
    return root


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def root_of(manifest):
    return manifest.filter("path = './'").first()


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5000, 31744])
def test_blake3_of_many_and_of_pieces_agree(size):
    data = bytes(k % 251 for k in range(size))
    assert blake3([b"x", data, b""])[1] == blake3([data])[0] == blake3_stream([data[k : k + 700] for k in range(0, size, 700)])


def test_blake3_vectors():
    assert blake3([b""])[0].hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3([b"foo\n"])[0].hex() == "49dc870df1de7fd60794cebce449f5ccdae575affaa67a24b62acb03e039db92"
    assert blake3([b"bar\n"])[0].hex() == "b3199d36d434044e6778b77d13f8dbaba32a73d9522c1ae8d0f73ef1ff14e71f"


def test_blake3_stream_over_several_subtrees():
    data = bytes(random.Random(1).randbytes(9_000_001))
    assert blake3_stream([data[k : k + 999_983] for k in range(0, len(data), 999_983)]) == blake3([data])[0]


@settings(max_examples=40, deadline=None)
@given(st.sampled_from([0, 5, 1024, 1025, 2048, 3000, 4096, 8192, 9000, 65536, 70001]), st.lists(st.integers(0, 70001), max_size=7), st.randoms(use_true_random=False))
def test_spans_anywhere_in_any_order(size, cuts, order):
    data = bytes(k * 7 % 251 for k in range(size))
    cuts = sorted({0, size, *(c for c in cuts if c < size)})
    nodes, ends = [], []
    for a, b in order.sample(list(zip(cuts, cuts[1:])), len(cuts) - 1):
        span = Span(a, size)
        for k in range(a, b, 777):
            span.update(data[k : min(b, k + 777)])
        span.finish()
        nodes += [(level, index, v.astype("<u4").tobytes()) for (level, index), v in span.nodes.items()]
        ends += span.ends
    assert combine(nodes, ends, size) == blake3([data])[0]


def test_parallel_id(spark):
    files = spark.range(30000).select(F.concat(F.lit("./d/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("checksum"), F.lit(1).cast("long").alias("size"))
    manifest = merkle.rollup(files)
    assert merkle.snapshot_id_parallel(manifest) == merkle.snapshot_id(manifest).first().id
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tasks without rows
    try:
        assert merkle.snapshot_id_parallel(manifest.limit(3)) == merkle.snapshot_id(manifest.limit(3)).first().id
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert merkle.snapshot_id_parallel(manifest.limit(1)) == merkle.snapshot_id(manifest.limit(1)).first().id


@pytest.mark.parametrize(("algorithm", "context"), list(NESTED_ROOTS))
def test_nested_tree(spark, tmp_path, algorithm, context):
    root = root_of(manifest_of(spark, str(grow(tmp_path / "t", NESTED)), algorithm=algorithm, context=context))
    assert (root.checksum, root["size"], root.permissions) == (NESTED_ROOTS[algorithm, context], 43, "700")


@pytest.mark.parametrize("algorithm", list(NESTED_WITHOUT_A))
def test_excluded_before_hashing(spark, tmp_path, algorithm):
    root = root_of(manifest_of(spark, str(grow(tmp_path / "t", NESTED)), exclude="/t/a(/|$)", algorithm=algorithm))
    assert (root.checksum, root["size"]) == (NESTED_WITHOUT_A[algorithm], 22)


def test_other_trees(spark, tmp_path):
    simple = manifest_of(spark, str(grow(tmp_path / "s", {"foo": "foo", "bar": "bar"})))
    assert root_of(simple).checksum == "e2b4329871fef9f50a20ba5d1475ee474f1df4091fe49002fd2bbcc42e6a04d5"
    assert id_of(text_of(simple)) == "aa91e498f401ea9e6ddbaa1138a0dbeb030fab8defc1252d80c77ebefafbc70d"
    assert merkle.snapshot_id(simple).first().id == merkle.snapshot_id_streamed(simple) == id_of(text_of(simple))
    two = manifest_of(spark, str(grow(tmp_path / "two", {"a/a1/foo": "foo", "b/b1/bar": "bar"})))
    assert id_of(text_of(two)) == "709eb24c97350626cda3e1f8bf7ff80fb7635c50d5a038e72919556dbbc79fd1"
    same = manifest_of(spark, str(grow(tmp_path / "same", {"foo.txt": "", "bar.txt": ""})))
    assert root_of(same).checksum == "dba5865c0d91b17958e4d2cac98c338f85cbbda07b71a020ab16c391b5e7af4b"
    assert id_of(text_of(same)) == "c678a299380893769bd7795628b96147229b410a9d5a5b7cae563bcae3c27857"
    doc = manifest_of(spark, str(grow(tmp_path / "doc", {"a/a1": "a1", "a/a2": "a2", "base": "base"})))
    assert (root_of(doc).checksum, root_of(doc)["size"]) == ("4257cc46336b9d0ae70a3104ae0382ac6a75da0ee49ffe69b423997e872276a7", 11)


def test_scan_of_hidden_empty_and_linked(spark, tmp_path):
    root = grow(tmp_path / "t", {".hidden": "x", "_under": "y", ".git/config": "z", "a/f": "f", "with space": "s"})
    (root / "empty").mkdir(mode=0o755)
    (root / "a_link").symlink_to(root / "a")
    (root / "a" / "up").symlink_to(root)
    found = {r.path: r for r in scan(spark, str(root)).collect()}
    assert {"./", "./.hidden", "./_under", "./.git/", "./.git/config", "./a/", "./a/f", "./a_link/", "./a_link/f", "./empty/", "./with space"} <= set(found)
    assert "./a/up/" not in found
    followed = {r.path: r.checksum for r in manifest_of(spark, str(root)).collect()}
    assert followed["./a/"] == followed["./a_link/"]
    assert not [r.path for r in scan(spark, str(root), follow=False).collect() if "link" in r.path]
    assert followed["./empty/"] == blake3([b""])[0].hex()
    assert "./.git/" not in {r.path for r in scan(spark, str(root), exclude="%common%").collect()}
    absolute = {r.path for r in scan(spark, str(root), absolute=True, algorithm="none").collect()}
    assert f"{root}/" in absolute and f"{root}/a/f" in absolute


def test_missing_root(spark, tmp_path):
    with pytest.raises(Exception, match="none"):
        scan(spark, str(tmp_path / "none")).collect()


FILES = st.dictionaries(st.lists(st.sampled_from(["a", "b", "c c"]), min_size=0, max_size=3).map(lambda d: "".join(f"{x}/" for x in d) + "f"), st.sampled_from(["x", "y", "z"]), min_size=1, max_size=6)


def naive(files: dict[str, str]) -> dict[str, tuple[str, int]]:
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {f"./{p}": (h(t), len(t)) for p, t in files.items()}

    def folder(name: str) -> tuple[str, int]:
        children = []
        below = {p[len(name) :].split("/")[0] for p in out if p.startswith(name) and p != name and "/" in p[len(name) :]}
        for b in sorted(below):
            children.append(folder(f"{name}{b}/"))
        children += [v for p, v in list(out.items()) if p.startswith(name) and p != name and "/" not in p[len(name) :]]
        out[name] = (h("".join(sorted({c for c, _ in children}))), sum(s for _, s in children))
        return out[name]

    folder("./")
    return out


@settings(max_examples=8, deadline=None)
@given(FILES)
def test_rollup_equals_recursion(spark, files):
    df = spark.createDataFrame([(f"./{p}", hashlib.sha256(t.encode()).hexdigest(), len(t)) for p, t in files.items()], "path string, checksum string, size long")
    got = {r.path: (r.checksum, r["size"]) for r in merkle.rollup(df).collect()}
    assert got == naive(files)
    assert {r.path: (r.checksum, r["size"]) for r in merkle.rollup(df.orderBy(F.rand()), streamed=True).collect()} == got
    assert {r.path: r["size"] for r in merkle.directory_sizes(df).collect()} == {p: v[1] for p, v in got.items() if p.endswith("/")}


def test_rollup_ignores_order_and_copies(spark):
    base = [("./d/a", "1" * 64, 3), ("./d/b", "2" * 64, 4)]
    roll = lambda r: {x.path: x for x in merkle.rollup(spark.createDataFrame(r, "path string, checksum string, size long")).collect()}
    one, two = roll(base), roll([*base[::-1], ("./d/c", "1" * 64, 3)])
    assert one["./d/"].checksum == two["./d/"].checksum and (one["./d/"]["size"], two["./d/"]["size"]) == (7, 10)


def test_deep_tree_cuts_lineage(spark):
    path = "./" + "d/" * 20 + "f"
    got = merkle.rollup(spark.createDataFrame([(path, "a" * 64, 5)], "path string, checksum string, size long"))
    assert got.count() == 22 and root_of(got)["size"] == 5


def test_orphans_of_unlisted_folders(spark):
    files = spark.createDataFrame([("./a/b/f", "1" * 64, 1), ("./g", "2" * 64, 2)], "path string, checksum string, size long")
    dirs = spark.createDataFrame([("./",), ("./a/b/",)], "path string")  # ./a/ is left out
    got = {r.path: r["size"] for r in merkle.rollup(files, dirs).collect()}
    assert got == {"./a/b/f": 1, "./g": 2, "./": 2, "./a/b/": 1}


TEXT = "# comment\nD 700 aa 9 ./\nF 600 bb 9 ./with space\nbad line\nF 6x0 cc 1 ./x\n"


def test_parsing(spark):
    assert rows(parse_text(spark, TEXT)) == [("D", "700", "aa", 9, "./"), ("F", "600", "bb", 9, "./with space")]
    assert id_of(TEXT) == id_of(TEXT.split("\n", 1)[1])


def test_path_filters(spark):
    m = spark.createDataFrame([("F", "600", "a", 1, p) for p in ("./foo", "./a/a1", "./ab", "./b/foo")], "path_type string, permissions string, checksum string, size long, path string")
    paths = lambda p: sorted(r.path for r in algebra.only_paths(m, p).collect())
    assert paths("foo") == ["./foo"] and paths("a") == paths("./a") == ["./a/a1", "./ab"] and paths("a/") == ["./a/a1"]
    assert paths("foo,b") == ["./b/foo", "./foo"] and len(paths("")) == 4
    assert algebra.expand_excludes("%system%")[1] is False and "node_modules" in algebra.expand_excludes("x|%common%")[0]


def test_difference_applied_gives_target(spark):
    schema = "path_type string, permissions string, checksum string, size long, path string"
    a = spark.createDataFrame([("F", "600", "1", 1, "./x"), ("F", "600", "2", 1, "./y"), ("F", "600", "3", 1, "./z")], schema)
    b = spark.createDataFrame([("F", "600", "1", 1, "./x"), ("F", "644", "2", 1, "./y"), ("F", "600", "4", 1, "./w")], schema)
    applied = algebra.additions(algebra.deletions(a, b), a).unionByName(algebra.additions(a, b))
    assert rows(applied) == rows(b)
    assert {r.path: r.change for r in algebra.difference(a, b).collect()} == {"./x": "same", "./y": "modified", "./z": "deleted", "./w": "added"}


def test_layout(spark):
    one = spark.createDataFrame([("0123456789abcdef",)], "c string")
    path = one.select(objects.sharded(F.col("c")).alias("p")).first().p
    assert path == ".objects/012/345/678/9abcdef" == shard("0123456789abcdef")
    assert one.select(objects.checksum_of(objects.sharded(F.col("c"), "manifests")).alias("c")).first().c == "0123456789abcdef"
    uris = spark.createDataFrame([("s3://b/x/y",), ("file:///tmp/x",), ("Bad-1://b",)], "u string").select(objects.store_uri(F.col("u")).alias("s")).collect()
    assert [tuple(r.s) for r in uris] == [("s3", "b", "x/y"), ("file", "", "tmp/x"), (None, "b", "")]


def test_digest_registry(spark):
    register("half", lambda c: F.substring(F.md5(c), 1, 16), hashlib.md5)
    one = spark.createDataFrame([("a",), (None,)], "c string")
    assert one.select(digest(F.col("c"), "half").alias("d")).first().d == hashlib.md5(b"a").hexdigest()[:16]
    assert [r.d for r in one.select(digest(F.col("c"), "b3sum").alias("d")).collect()] == [blake3([b"a"])[0].hex(), None]
    with pytest.raises(ValueError, match="unknown digest"):
        digest(F.col("c"), "nosum")


EVENTS = [("s3://foo", "a"), ("s3://bar", "a"), ("/local/foo", "a"), ("/local/foo", "b"), ("/local/foo", "c"), ("s3://bar", "c")]


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "catalog"))
    assert c.locations().count() == 0
    for location, letter in EVENTS:
        c.log("manifest", letter * 64, location)
    h = c.history()
    assert {(r.location, r.id[0]) for r in catalog.locations(h).collect()} == {("s3://foo", "a"), ("s3://bar", "c"), ("/local/foo", "c")}
    assert catalog.ancestors(h, "a" * 64).count() == 0
    assert {(r.location, r.id[0]) for r in catalog.ancestors(h, "c" * 64).collect()} == {("s3://bar", "a"), ("/local/foo", "b")}
    assert [(r.location, r.id[0]) for r in catalog.ancestors(h, "c" * 64, "s3://bar").collect()] == [("s3://bar", "a")]
    assert catalog.revisions(h, "/not/avail").count() == 0
    assert [(r.id[0], r.previous_id and r.previous_id[0]) for r in catalog.revisions(h, "s3://bar").collect()] == [("c", "a"), ("a", None)]
    assert catalog.latest_id(h, "/local/foo").first().id == "c" * 64
    assert '"previous_id":null' in "".join(r.json for r in c.revisions("s3://bar").collect())
    assert sorted(r.id[0] for r in catalog.lineage(h, "c" * 64).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="constraint failed: id = invalid"):
        c.log("manifest", "invalid", "s3://foo")
    c.note_version()
    assert c._table("system", "version string, created_at timestamp").count() == 1


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from("abc")), max_size=20))
def test_collapse_equals_replay(spark, events):
    log = spark.createDataFrame([("e", i, w, k, k) for k, (w, i) in enumerate(events)], "event string, id string, location string, created_at long, seq long")
    expected, last = [], {}
    for k, (w, i) in enumerate(events):
        if last.get(w) != i:
            expected.append((i, last.get(w), w, k))
            last[w] = i
    assert sorted(catalog.collapse(log, "seq").collect(), key=lambda r: r[3]) == expected


def test_incremental_hashes_only_what_changed(spark):
    mark = incremental.fingerprint("path", "mtime")
    old = spark.createDataFrame([("a", 1, "old-a"), ("b", 1, "old-b")], "path string, mtime long, checksum string").withColumn("fingerprint", mark)
    new = spark.createDataFrame([("a", 1, "A"), ("b", 2, "B"), ("c", 1, None)], "path string, mtime long, content string").withColumn("fingerprint", mark)
    got = {r.path: (r.checksum, r.reused) for r in incremental.rehash(new, old).collect()}
    assert got == {"a": ("old-a", True), "b": (hashlib.sha256(b"B").hexdigest(), False), "c": (None, False)}


@pytest.fixture
def space(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "cache"), str(tmp_path / "catalog"))


def test_stage_push_pull_round_trip(space, tmp_path):
    source = grow(tmp_path / "source", NESTED | {"copy": "r1f", "with space": "w"})
    snapshot = space.stage(str(source))
    assert space.stage(str(source)) == snapshot
    store = f"file://{tmp_path}/store"
    assert space.push(store, snapshot=snapshot, dry_run=True).count() == 9
    space.push(store, snapshot=snapshot)
    assert space.push(store, snapshot=snapshot) == snapshot
    other = Workspace(space.spark, str(tmp_path / "other"))
    assert other.fetch(store, snapshot, dry_run=True).count() == 9
    grow(tmp_path / "target", {})
    other.pull(store, snapshot, str(tmp_path / "target"))
    assert other.id(str(tmp_path / "target")) == snapshot
    assert stat.S_IMODE(os.stat(tmp_path / "target" / "r1f").st_mode) == 0o600
    assert {r.location for r in catalog.locations(space.catalog.history()).collect()} == {str(source), store}


def test_checkout_is_all_or_nothing(space, tmp_path):
    source = grow(tmp_path / "source", {"foo": "foo", "a/a1": "a1"})
    snapshot = space.stage(str(source))
    target = grow(tmp_path / "target", {"foo": "other"})
    with pytest.raises(CheckoutError, match="foo"):
        space.checkout(snapshot, str(target))
    assert not (target / "a").exists()
    assert {r.path for r in space.checkout(snapshot, str(target), paths="a", dry_run=True).collect()} == {"./a/", "./a/a1"}
    space.checkout(snapshot, str(target), paths="a")
    assert (target / "a" / "a1").read_text() == "a1\n" and (target / "foo").read_text() == "other\n"
    space.checkout(snapshot, str(target), force=True)
    assert space.id(str(target)) == snapshot
    assert space.checkout(snapshot, str(target)).count() == 0  # up to date
    linked = tmp_path / "linked"
    space.checkout(snapshot, str(linked), linked=True)
    assert os.stat(linked / "foo").st_nlink == 2


def test_small_files_are_hashed_together(tmp_path, monkeypatch):
    texts = {f"d{k % 7}/f{k}": "x" * (k * 37) for k in range(200)} | {"empty": "", "large": "y" * 2_500_000}
    root = grow(tmp_path / "tree", texts, end="")
    expected = {f"./{name}": blake3([text.encode()], "secret")[0].hex() for name, text in texts.items()}
    alone = []
    stream = hashing.blake3_stream
    monkeypatch.setattr(hashing, "blake3_stream", lambda pieces, context=None: alone.append(1) or stream(pieces, context))
    reader = fstree._Reader({"path": str(root), "algorithm": "blake3", "context": "secret", "parts": "1"})
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert {r[4]: r[2] for r in rows if r[0] == "F"} == expected and len(alone) == 1
    assert {r[4] for r in rows if r[0] == "D"} == {"./", *(f"./d{k}/" for k in range(7))} and {r[2] for r in rows if r[0] == "D"} == {None}

    alone.clear()
    wanted = [(str(root / name), str(tmp_path / "to" / name), blake3([text.encode()])[0].hex()) for name, text in texts.items()]
    grow(tmp_path / "to", {"d0/f0": "tampered", "d1/f1": texts["d1/f1"]}, end="")
    assert stores.persist_all(wanted, "blake3") == 201 and len(alone) == 1
    assert all((tmp_path / "to" / name).read_text() == text for name, text in texts.items())
    assert stores.persist_all(wanted, "blake3") == 0
    with pytest.raises(ValueError, match="empty is not"):
        stores.persist_all([(wanted[-2][0], str(tmp_path / "bad" / "x"), "f" * 64)], "blake3")
    assert not os.listdir(tmp_path / "bad")


def test_checkout_gives_new_directories_their_modes(space, tmp_path):
    source = grow(tmp_path / "source", {"a/b/foo": "foo", "c/bar": "bar", "old/x": "x"})
    modes = {"": 0o750, "a": 0o755, "a/b": 0o500, "c": 0o711}
    for name, mode in modes.items():
        os.chmod(source / name, mode)
    snapshot = space.stage(str(source))
    space.checkout(snapshot, str(tmp_path / "new"))
    assert {n: stat.S_IMODE(os.stat(tmp_path / "new" / n).st_mode) for n in modes} == modes
    assert space.id(str(tmp_path / "new")) == snapshot
    target = grow(tmp_path / "target", {"c/own": "own"})
    space.checkout(snapshot, str(target))
    assert {n: stat.S_IMODE(os.stat(target / n).st_mode) for n in modes} == modes | {"": 0o700, "c": 0o700}


def test_small_objects_in_packs(space, tmp_path):
    """Many small objects and a large one through packed stores; damaged packs are seen, mended and purged."""
    spark = space.spark
    texts = {f"d{k % 3}/f{k}": f"text {k}" for k in range(300)} | {"copy": "text 7", "empty": "", "large": "y" * 100_000}
    source, store, cache = grow(tmp_path / "source", texts), f"packed://{tmp_path}/store", tmp_path / "cache"
    snapshot = space.stage(str(source))
    packed = Workspace(spark, f"packed://{cache}2")
    assert packed.push(store, str(source)) == snapshot
    assert rows(packed.cache.inventory()) == rows(space.cache.inventory())
    files = lambda at: [p for p in (tmp_path / at).rglob("*") if p.is_file()]
    assert len(files("store/.objects")) == 1 and not [p for p in files("store/.packs") if p.suffix != ".parquet"]
    size = lambda at: sum(os.lstat(p).st_blocks * 512 for p in (tmp_path / at).rglob("*"))
    assert 5 * size("store") < size("cache")
    assert packed.cache.put_objects(space.cache.object_paths()) == 0 and space.cache.put_objects(packed.cache.object_paths()) == 0

    other = Workspace(spark, f"packed://{tmp_path}/other")
    other.pull(store, snapshot, str(tmp_path / "target"))
    assert other.id(str(tmp_path / "target")) == snapshot
    other.checkout(snapshot, str(tmp_path / "linked"), linked=True)
    assert os.stat(tmp_path / "linked" / "large").st_nlink == 2 and other.id(str(tmp_path / "linked")) == snapshot
    plain = Workspace(spark, str(tmp_path / "plain"))
    plain.fetch(store, snapshot)  # from packs to files
    assert rows(plain.cache.inventory()) == rows(space.cache.inventory())

    # other contents under an object's name, and a pack that can't be read at all
    first, *_, last = sorted(files("other/.packs"))
    named = dict(packs.names(str(first)))
    bad = min(named)
    held = [(c, packs.packed(s) if c != bad else b"tampered") for c, s in named.items()]
    with packs._writer(str(first)) as writer:
        packs._put(writer, held)
    lost = {c for c, _ in packs.names(str(last))}
    last.write_bytes(b"cut off")
    failed = lambda: {r.checksum for r in other.verify(snapshot).filter("status = 'FAILED'").collect()}
    assert failed() == {bad, *lost} and [r.checksum for r in other.verify_cache().collect()] == [bad]
    with pytest.raises(CheckoutError, match="not in the cache"):
        other.checkout(snapshot, str(tmp_path / "t"))
    assert [r.checksum for r in other.cache.purge().collect()] == [bad] and not last.exists()
    assert failed() == {bad, *lost} and other.verify_cache().count() == 0  # the others of the first pack stay
    other.fetch(store, snapshot)
    assert not failed() and rows(other.cache.inventory()) == rows(space.cache.inventory())
    # an object that is damaged is replaced without a purge, alone in a pack too
    alone = LocalStore(spark, str(tmp_path / "alone"), pack=packs.PACKED)
    one = space.cache.object_paths().filter(F.col("checksum") == bad)
    assert alone.put_objects(one) == 1
    with packs._writer(str(files("alone/.packs")[0])) as writer:
        packs._put(writer, [(bad, b"tampered")])
    assert alone.put_objects(one) == 1 and alone.put_objects(one) == 0
    assert [(r.checksum, r.actual_checksum) for r in alone.inventory().collect()] == [(bad, bad)]
    with pytest.raises(Exception, match="is not"):
        alone.put_objects(spark.createDataFrame([("f" * 64, str(source / "empty"))], "checksum string, source string"))
    assert len(files("alone/.packs")) == 1
    other.flush()
    assert not files("other/.packs")


def test_pull_holds_one_tree_at_a_time(spark, tmp_path, monkeypatch):
    """On disk, the query over files holds the tree and little else after each of its steps."""
    size = lambda at: sum(os.lstat(p).st_blocks * 512 for p in at.rglob("*"))
    grow(tmp_path / "tree", {f"d{k % 5}/f{k}": f"text {k} " * 40 for k in range(400)})
    tree, seen = size(tmp_path / "tree"), []

    def noted(step):
        def run(*args, **kwargs):
            out = step(*args, **kwargs)
            seen.append(size(tmp_path))
            return out

        return run

    for name in ("stage", "push", "fetch", "checkout"):
        monkeypatch.setattr(Workspace, name, noted(getattr(Workspace, name)))
    expected = rows(manifest_of(spark, str(tmp_path / "tree"), algorithm="sha256"))
    assert rows(queries.pulled_manifest(spark, "", str(tmp_path))) == expected
    assert len(seen) == 4 and max(seen) < 1.3 * tree


def test_verify_purge_and_restage(space, tmp_path):
    source = grow(tmp_path / "source", {"foo": "foo", "bar": "bar"})
    snapshot = space.stage(str(source))
    assert {r.status for r in space.verify(snapshot).collect()} == {"OK"}
    bad = blake3([b"foo\n"])[0].hex()
    path = f"{space.cache.root}/{shard(bad)}"
    open(path, "w").write("tampered")
    assert {r.checksum: r.status for r in space.verify(snapshot).collect()}[bad] == "FAILED"
    assert [r.checksum for r in space.verify_cache().collect()] == [bad]
    assert space.verify(snapshot, purge=True).filter("status = 'FAILED'").count() == 1
    assert not os.path.exists(path)
    with pytest.raises(CheckoutError, match="not in the cache"):
        space.checkout(snapshot, str(tmp_path / "t"))
    space.stage(str(source))
    assert {r.status for r in space.verify(snapshot).collect()} == {"OK"}
    space.flush()
    assert not os.path.exists(path)


def test_push_mends_tampered_objects(space, tmp_path):
    source = grow(tmp_path / "source", {"foo": "foo", "bar": "bar"})
    snapshot = space.stage(str(source))
    store = tmp_path / "store"
    bad = blake3([b"foo\n"])[0].hex()
    path = store / shard(bad)
    path.parent.mkdir(parents=True)
    path.write_text("tampered")
    plan = {r.checksum: r.reason for r in space.push(str(store), snapshot=snapshot, dry_run=True).collect()}
    assert plan[bad] == "tampered" and len(plan) == 2
    space.push(str(store), snapshot=snapshot)
    assert path.read_text() == "foo\n"


def test_fetch_refuses_what_is_wrong(space, tmp_path):
    source = grow(tmp_path / "source", {"foo": "foo"})
    store = tmp_path / "store"
    snapshot = space.push(str(store), str(source))
    other = Workspace(space.spark, str(tmp_path / "other"))
    with pytest.raises(FileNotFoundError):
        other.fetch(str(store), "0" * 64)
    manifest = store / shard(snapshot, "manifests")
    text = manifest.read_text()
    manifest.write_text(text.replace("./foo", "./fox"))
    with pytest.raises(ValueError, match="another id"):
        other.fetch(str(store), snapshot)
    manifest.write_text("# a comment\n" + text)
    (store / shard(blake3([b"foo\n"])[0].hex())).write_text("tampered")
    with pytest.raises(FileNotFoundError, match="missing or damaged"):
        other.fetch(str(store), snapshot)
    assert not other.cache.has_manifest(snapshot)


def test_stores_by_protocol(spark, tmp_path):
    assert isinstance(open_store(spark, f"file://{tmp_path}"), LocalStore)
    with pytest.raises(ValueError, match="no store for s4"):
        open_store(spark, "s4://bucket")


def test_integrity_of_inventories(spark):
    good, bad = "a" * 64, "b" * 64
    inventory = spark.createDataFrame([(shard(good), good), (shard(bad), "c" * 64)], "path string, actual_checksum string")
    assert [r.checksum for r in integrity.verify_inventory(inventory).collect()] == [bad]
    assert [r.path for r in integrity.purge_plan(inventory).collect()] == [shard(bad)]
    assert [r.path for r in integrity.purged(inventory).collect()] == [shard(good)]


def test_event_stream(spark, tmp_path):
    from merkleframe.streaming.events import ingest

    source = tmp_path / "in"
    schema = "id string, location string, created_at timestamp, seq long"
    import datetime as dt

    at = lambda k: dt.datetime(2024, 1, 1, 0, 0, k)
    log = [(i * 64, w, at(k), k) for k, (w, i) in enumerate([*EVENTS, ("s3://bar", "c"), ("s3://bar", "a")])]
    for part in (log[:3], log[3:], [("a" * 64, "s3://bar", at(9), 9)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = ingest(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination(120)
        assert query.exception() is None
    # the last batch holds nothing new
    got = rows(spark.read.parquet(str(tmp_path / "out")).select("id", "location", "created_at"))
    assert got == rows(catalog.collapse(spark.createDataFrame(log, schema), "seq").select("id", "location", "created_at"))


def test_arrow_store_round_trip(space, tmp_path):
    """Push to, and fetch from, a store that Arrow opens by URI; tampered and cut-off objects are refused or mended."""
    uri = f"arrow://{tmp_path}/far"
    register_store("arrow", lambda spark, rest: ArrowStore(spark, f"file://{rest}"))
    source = grow(tmp_path / "source", {"foo": "foo", "sub/bar": "bar", "sub/foo": "foo"})
    plan = space.push(uri, snapshot=space.stage(str(source)), dry_run=True)
    assert {r.reason for r in plan.collect()} == {"missing"} and plan.count() == 2
    snapshot = space.push(uri, str(source))
    far = ArrowStore(space.spark, f"file://{tmp_path}/far")
    assert far.has_manifest(snapshot) and not far.has_manifest("0" * 64)
    assert sorted(r.checksum for r in far.inventory().collect()) == sorted(blake3([b"foo\n", b"bar\n"])[k].hex() for k in (0, 1))
    assert {r.actual_checksum for r in far.inventory("md5").collect()} == {hashlib.md5(b).hexdigest() for b in (b"foo\n", b"bar\n")}
    assert far.put_objects(space.cache.object_paths()) == 0
    other = Workspace(space.spark, str(tmp_path / "other"))
    assert other.pull(uri, snapshot, str(tmp_path / "out"), dry_run=True).count() == 2 and not (tmp_path / "out").exists()
    other.pull(uri, snapshot, str(tmp_path / "out"))
    assert other.id(str(tmp_path / "out")) == snapshot
    bad = tmp_path / "far" / shard(blake3([b"foo\n"])[0].hex())
    bad.write_text("fo")
    with pytest.raises(FileNotFoundError, match="missing or damaged"):
        Workspace(space.spark, str(tmp_path / "third")).fetch(uri, snapshot)
    with pytest.raises(Exception, match="is not"):
        far.put_objects(space.spark.createDataFrame([("f" * 64, f"file://{bad}")], "checksum string, source string"))
    assert [r.checksum for r in far.purge().collect()] == [blake3([b"foo\n"])[0].hex()] and not bad.exists()
    with pytest.raises(FileNotFoundError):
        far.manifest("0" * 64)
    assert ArrowStore(space.spark, f"file://{tmp_path}/none").inventory().count() == 0


def test_memo_reads_changed_files_only(spark, tmp_path):
    root = grow(tmp_path / "tree", {"a": "aaa", "b": "bbb", "sub/c": "ccc"})
    plain = sorted(map(str, manifest_of(spark, str(root)).collect()))
    manifest, memo = manifest_with_memo(spark, str(root))
    assert sorted(map(str, manifest.collect())) == plain
    wrong = memo.withColumn("checksum", F.lit("0" * 64))  # shows whose checksum is taken over
    (root / "a").write_text("AAA\n")  # the same size
    os.utime(root / "a", ns=(1, 1))
    again, _ = manifest_with_memo(spark, str(root), wrong)
    taken = {r.path: r.checksum for r in again.collect() if r.path_type == "F"}
    assert taken == {"./a": blake3([b"AAA\n"])[0].hex(), "./b": "0" * 64, "./sub/c": "0" * 64}
    third, _ = manifest_with_memo(spark, str(root), memo, memo_id(memo))
    assert sorted(map(str, third.collect())) == sorted(map(str, manifest_of(spark, str(root)).collect()))
    with pytest.raises(ValueError, match="another id"):
        manifest_with_memo(spark, str(root), wrong, memo_id(memo))


def test_another_catalog_and_dry_runs(spark, tmp_path):
    seen = []

    class Noted:
        def log(self, event, snapshot, location):
            seen.append((event, location))

    catalog.register_catalog("noted", lambda spark, place: Noted())
    space = Workspace(spark, str(tmp_path / "cache"), "noted:anywhere")
    source = grow(tmp_path / "source", {"foo": "foo"})
    assert space.stage(str(source), dry_run=True).count() == 1 and not seen
    snapshot = space.stage(str(source))
    assert space.id(str(source)) == snapshot and [e for e, _ in seen] == ["stage", "manifest"]
    (tmp_path / "cache" / shard(blake3([b"foo\n"])[0].hex())).write_text("tampered")
    assert space.verify_cache(purge=True, dry_run=True).count() == 1 and space.verify_cache(purge=True).count() == 1
    assert space.verify_cache().count() == 0
    text = space.cache.manifest(snapshot)
    assert sorted(map(str, space.manifest(text="# note\n" + text).collect())) == sorted(map(str, space.manifest(snapshot=snapshot).collect()))
    with pytest.raises(ValueError, match="not an id"):
        space.manifest(snapshot="abc")
    assert space.manifest(str(source), stage=True).count() == 2


def test_other_exclude_lists(spark, tmp_path):
    root = grow(tmp_path / "tree", {"keep": "x", "out/a": "y", ".git/b": "z"})
    spark.dataSource.register(FsTree)
    read = lambda **o: sorted(r.path for r in spark.read.format("fstree").options(exclude="%common%", algorithm="none", **o).load(str(root)).filter("path_type = 'F'").collect())
    assert read() == ["./keep", "./out/a"] and read(commonExcludes="out") == ["./.git/b", "./keep"]
