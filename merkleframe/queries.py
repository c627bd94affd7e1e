"""The engine's queries over the driver's tables, and the same in SQL.

``documents`` is a file tree (./lang/source/doc_id with the text as content). Its curated version leaves
toxic documents out, has low-quality ones in lower case, and adds the benchmark's items. ``events`` is an
event log: user_id is the location, the digest of event_type the snapshot id.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import digest
from .lineage import checkpoint, release, shared_folder
from .operators import algebra, catalog, incremental, integrity, merkle, objects
from .plans.workflows import Workspace, manifest_of, manifest_with_memo, memo_id
from .schema import MANIFEST_COLUMNS, format_line, parse_lines
from .sources.fstree import scan
from .sources.stores import LocalStore
from .streaming.events import HISTORY, ingest

PURCHASE = "purchase"
USER = "42"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("./"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), "doc_id")


def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = _contents(spark, sf_dir).join(labels, "doc_id", "left").filter(F.coalesce("toxic", F.lit(0)) == 0)
    low = F.coalesce(F.col("quality") == 0, F.lit(False))
    kept = docs.select("path", F.when(low, F.lower("content")).otherwise(F.col("content")).alias("content"), low.cast("int").alias("changed"))
    items = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("./benchmark/items/"), F.col("item_id").cast("string")).alias("path"), F.col("text").alias("content"), F.lit(0).alias("changed"))
    return kept.unionByName(items)


def _files(contents: DataFrame, algorithm: str = "sha256") -> DataFrame:
    return contents.select("path", digest(F.col("content"), algorithm).alias("checksum"), F.octet_length("content").cast("long").alias("size"))


def _manifest(spark: SparkSession, sf_dir: str, version: str = "base") -> DataFrame:
    contents = _contents(spark, sf_dir) if version == "base" else _curated(spark, sf_dir)
    return merkle.rollup(_files(contents))


def _file_rows(files: DataFrame) -> DataFrame:
    return files.select(F.lit("F").alias("path_type"), F.lit("600").alias("permissions"), "checksum", "size", "path")


def _hashed(contents: DataFrame) -> DataFrame:
    """Paths, checksums and sizes, once: as a join key, the digest of the contents would be computed again and again."""
    return checkpoint(_files(contents))


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The whole manifests of the base and the curated version."""
    return tuple(checkpoint(_manifest(spark, sf_dir, version)) for version in ("base", "curated"))


def _objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The base version's file rows, and an inventory of objects named by their digests, with the curated version's bytes written over them; of several, the least path's."""
    base, curated = _hashed(_contents(spark, sf_dir)), _hashed(_curated(spark, sf_dir))
    first = base.groupBy("checksum").agg(F.min("path").alias("path"))
    now = first.join(curated.select("path", F.col("checksum").alias("actual_checksum")), "path")
    return _file_rows(base), now.select("checksum", "actual_checksum", objects.sharded(F.col("checksum")).alias("path"))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(spark, sf_dir)[1]


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return events.select(F.lit("push").alias("event"), F.sha2("event_type", 256).alias("id"), F.col("user_id").cast("string").alias("location"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collapse(_log(spark, sf_dir), "seq")


def _purchase_id(spark: SparkSession) -> str:
    import hashlib

    return hashlib.sha256(PURCHASE.encode()).hexdigest()


def file_manifest(spark, sf_dir):
    return _file_rows(_files(_contents(spark, sf_dir)))


def full_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir)


def directories_of_level(level: int):
    def query(spark, sf_dir):
        rows = algebra.only_directories(_manifest(spark, sf_dir))
        return rows.filter(merkle.depth(F.col("path")) == level).select("path", "checksum", "size")

    return query


def snapshot_id(spark, sf_dir):
    return merkle.snapshot_id(_manifest(spark, sf_dir), "sha256")


def manifest_lines(spark, sf_dir):
    return _manifest(spark, sf_dir).orderBy("path").select(format_line().alias("line"))


def parsed_manifest(spark, sf_dir):
    lines = _manifest(spark, sf_dir).select(format_line().alias("value"))
    noise = spark.createDataFrame([("# a comment",), ("",), ("X 600 00 1 ./no",), ("F 600 zz 1 ./no",)], "value string")
    return parse_lines(lines.unionByName(noise))


def directory_sizes(spark, sf_dir):
    return merkle.directory_sizes(_files(_contents(spark, sf_dir)))


def inventory_id(spark, sf_dir):
    return merkle.inventory_id(_inventory(spark, sf_dir).select("checksum", "path"), "context", "sha256")


def object_layout(spark, sf_dir):
    return objects.distinct_objects(file_manifest(spark, sf_dir)).select("checksum", "size", objects.sharded(F.col("checksum")).alias("path"))


def path_to_checksum(spark, sf_dir):
    layout = object_layout(spark, sf_dir).select("path")
    return layout.select("path", objects.checksum_of(F.col("path")).alias("checksum"))


def exclude_rollup(spark, sf_dir):
    return merkle.rollup(_files(algebra.exclude(_contents(spark, sf_dir), "^\\./fr/|/src1[0-9]/")))


def paths_filter(spark, sf_dir):
    return algebra.only_paths(_manifest(spark, sf_dir), "en/src1,./de/src0/")


def manifest_additions(spark, sf_dir):
    return algebra.additions(*_two(spark, sf_dir))


def manifest_deletions(spark, sf_dir):
    return algebra.deletions(*_two(spark, sf_dir))


def manifest_unchanged(spark, sf_dir):
    return algebra.unchanged(*_two(spark, sf_dir))


def manifest_difference(spark, sf_dir):
    return algebra.difference(*_two(spark, sf_dir))


def missing_objects(spark, sf_dir):
    base, curated = _hashed(_contents(spark, sf_dir)), _hashed(_curated(spark, sf_dir))
    return objects.missing(_file_rows(curated), base.select("checksum").distinct())


def tampered_objects(spark, sf_dir):
    return objects.tampered(*_objects(spark, sf_dir))


def transfer_plan(spark, sf_dir):
    return objects.transfers(*_objects(spark, sf_dir))


def checkout_plan(spark, sf_dir):
    base, curated = _two(spark, sf_dir)
    cached = algebra.only_files(curated).filter(F.substring("checksum", 1, 1) < "c").select("checksum")
    return objects.checkout_plan(base, curated, cached)


def verify_status(spark, sf_dir):
    return integrity.verify_snapshot(*_objects(spark, sf_dir))


def verify_inventory(spark, sf_dir):
    return integrity.verify_inventory(_inventory(spark, sf_dir))


def purged_inventory(spark, sf_dir):
    return integrity.purged(_inventory(spark, sf_dir))


def duplicate_content(spark, sf_dir):
    return objects.duplicate_content(file_manifest(spark, sf_dir))


def history_collapse(spark, sf_dir):
    return _history(spark, sf_dir)


def locations_latest(spark, sf_dir):
    return catalog.locations(_history(spark, sf_dir))


def ancestors(spark, sf_dir):
    return catalog.ancestors(_history(spark, sf_dir), _purchase_id(spark))


def ancestors_at_location(spark, sf_dir):
    return catalog.ancestors(_history(spark, sf_dir), _purchase_id(spark), USER)


def revisions(spark, sf_dir):
    return catalog.revisions(_history(spark, sf_dir), USER)


def latest_id(spark, sf_dir):
    return catalog.latest_id(_history(spark, sf_dir), USER)


def catalog_json(spark, sf_dir):
    return catalog.as_json(_history(spark, sf_dir), "created_at", "id", "location", "previous_id")


def checked_log(spark, sf_dir):
    return catalog.checked(_log(spark, sf_dir))


def incremental_rehash(spark, sf_dir):
    # the change mark stands for a file's time: a text may change without a change of its size
    mark = incremental.fingerprint("path", "size", "changed")
    old = _files(_contents(spark, sf_dir)).withColumn("changed", F.lit(0)).withColumn("fingerprint", mark)
    scan = _curated(spark, sf_dir).withColumn("size", F.octet_length("content").cast("long")).withColumn("fingerprint", mark)
    return incremental.rehash(scan, old).select("path", "size", "checksum", "reused")


def store_uri_parse(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", objects.store_uri(F.col("url")).alias("uri")).select("page_id", "uri.protocol", "uri.bucket", "uri.base_dir")


def digests(spark, sf_dir):
    contents = _contents(spark, sf_dir)
    return contents.select("path", *(digest(F.col("content"), a).alias(a) for a in ("md5", "sha1", "sha256")))


def md5_manifest(spark, sf_dir):
    return merkle.rollup(_files(_contents(spark, sf_dir), "md5"), algorithm="md5")


def blake3_manifest(spark, sf_dir):
    return merkle.rollup(_files(_contents(spark, sf_dir), "blake3"), algorithm="blake3")


def blake3_keyed_manifest(spark, sf_dir):
    contents = _contents(spark, sf_dir)
    files = contents.select("path", digest(F.col("content"), "blake3", "secret").alias("checksum"), F.octet_length("content").cast("long").alias("size"))
    return merkle.rollup(files, algorithm="blake3", context="secret")


def _scratch(spark: SparkSession) -> str:
    """A new local path in the shared folder, for files."""
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    if ":" in folder.split("/")[0]:
        raise ValueError(f"{folder} is no folder that files can be written to")
    return f"{folder}/files-{uuid.uuid4().hex}"


def _as_files(contents: DataFrame, root: str) -> None:
    """Write (path, content) as files of mode 600 in folders of mode 700."""

    def written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                to = f"{root}/{path.removeprefix('./')}"
                folder = root
                for part in ("", *os.path.relpath(os.path.dirname(to), root).split("/")):
                    folder = os.path.normpath(f"{folder}/{part}")
                    os.makedirs(folder, exist_ok=True)
                    os.chmod(folder, 0o700)
                with open(to, "wb") as f:
                    f.write((content or "").encode())
                os.chmod(to, 0o600)
            yield frame[["path"]]

    os.makedirs(root, exist_ok=True)
    contents.select("path", "content").mapInPandas(written, "path string").count()


def _on_files(query: Callable[[SparkSession, str, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the documents as a tree of files, which is removed afterwards."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _scratch(spark)
        try:
            _as_files(_contents(spark, sf_dir), f"{folder}/tree")
            return checkpoint(query(spark, sf_dir, folder))
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def scan_manifest(spark, sf_dir, folder):
    return manifest_of(spark, f"{folder}/tree", algorithm="sha256")


def scan_excluded(spark, sf_dir, folder):
    return manifest_of(spark, f"{folder}/tree", exclude="/tree/fr(/|$)|/src1[0-9](/|$)", algorithm="sha256")


def memo_manifest(spark, sf_dir, folder):
    """A second scan, which takes the digests over from the first."""
    _, memo = manifest_with_memo(spark, f"{folder}/tree", algorithm="sha256")
    return manifest_with_memo(spark, f"{folder}/tree", memo, memo_id(memo), algorithm="sha256")[0]


def pulled_manifest(spark, sf_dir, folder):
    """Stage, push to a store, pull from there into another folder, and scan that.

    Small objects are in packs. What the following steps don't read is removed before them: each has only what
    the one before it wrote.
    """
    store = f"packed://{folder}/store"
    space, other = Workspace(spark, f"packed://{folder}/cache"), Workspace(spark, f"packed://{folder}/other")
    snapshot = space.stage(f"{folder}/tree")
    _removed(spark, f"{folder}/tree")
    space.push(store, snapshot=snapshot)
    space.flush()
    other.fetch_intact(store, snapshot)
    _removed(spark, f"{folder}/store")
    other.checkout(snapshot, f"{folder}/out")
    other.flush()
    release(spark)
    return manifest_of(spark, f"{folder}/out", algorithm="sha256")


def _removed(spark: SparkSession, folder: str) -> None:
    shutil.rmtree(folder)
    release(spark)


def store_inventory(spark, sf_dir, folder):
    """Objects put into a store; the inventory reads and hashes them again."""
    store = LocalStore(spark, f"{folder}/store", "sha256")
    rows = algebra.only_files(scan(spark, f"{folder}/tree", algorithm="sha256"))
    store.put_objects(rows.select("checksum", F.col("abs_path").alias("source")))
    return store.inventory()


def store_purged(spark, sf_dir, folder):
    """A store whose objects the curated version's bytes were written over, after its damaged objects are deleted."""
    base, curated = _hashed(_contents(spark, sf_dir)), _curated(spark, sf_dir)
    first = base.groupBy("checksum").agg(F.min("path").alias("path"))
    over = first.join(curated.select("path", "content"), "path").select(objects.sharded(F.col("checksum")).alias("path"), "content")
    _as_files(over, f"{folder}/store")
    store = LocalStore(spark, f"{folder}/store", "sha256")
    store.purge()
    return store.inventory()


def lineage(spark, sf_dir):
    """Extension: everything before a snapshot, through cycles."""
    return catalog.lineage(_history(spark, sf_dir), _purchase_id(spark))


def streamed_history(spark, sf_dir):
    """Extension: the event log as a stream, collapsed with state."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _log(spark, sf_dir).select("id", "location", "created_at").write.parquet(f"{folder}/in")
    events = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    ingest(events.withColumn("created_at", F.col("created_at").cast("timestamp")), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(HISTORY).parquet(f"{folder}/out").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


#: A small tree, and its root's BLAKE3 checksums, plain and with the context "secret".
_TREE = {"a/a1f": "a1f", "a/aa/aa1f": "aa1f", "a/aa/aaa/aaa1f": "aaa1f", "a/aa/aaa/aaa2f": "aaa2f", "b/bb/bbb/bbb1f": "bbb1f", "b/bb/bbb/bbb2f": "bbb2f", "c/cc/ccc/ccc1f": "ccc1f", "r1f": "r1f"}
_TREE_ROOTS = {"plain": "207d090daf06217a0920593ee642a90fcad85b9dccec02725e85311005f64327", "secret": "b64e60321e94894fe9e23522c527a9326521389944198910a3801987c2ab1a19"}


def blake3_roots(spark, sf_dir):
    tree = spark.createDataFrame([(f"./{p}", f"{t}\n") for p, t in _TREE.items()], "path string, content string")
    size = F.octet_length("content").cast("long").alias("size")
    roots = [
        merkle.rollup(tree.select("path", digest(F.col("content"), "blake3", context).alias("checksum"), size), algorithm="blake3", context=context).filter("path = './'").select(F.lit(name).alias("kind"), "checksum")
        for name, context in (("plain", None), ("secret", "secret"))
    ]
    return roots[0].unionByName(roots[1])


_DOCS = "SELECT './' || lang || '/' || source || '/' || doc_id AS path, text AS content, doc_id FROM documents"
_CURATED = f"""SELECT path, CASE WHEN quality = 0 THEN lower(content) ELSE content END AS content, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS changed
  FROM ({_DOCS}) d LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0
  UNION ALL SELECT './benchmark/items/' || item_id, text, 0 FROM benchmark"""


def _files_sql(contents: str, hash_name: str = "sha256") -> str:
    return f"SELECT path, {hash_name}(content) AS checksum, strlen(content)::BIGINT AS size FROM ({contents})"


def _rows_sql(contents: str) -> str:
    return f"SELECT 'F' AS path_type, '600' AS permissions, checksum, size, path FROM ({_files_sql(contents)})"


def _manifest_sql(contents: str, hash_name: str = "sha256", then: str = "SELECT path_type, permissions, checksum, size, path FROM manifest") -> str:
    """Three levels of folders, each over the one below."""
    rolled = lambda source, up: f"SELECT {up} AS path, {hash_name}(string_agg(DISTINCT checksum, '' ORDER BY checksum)) AS checksum, sum(size)::BIGINT AS size FROM {source} GROUP BY 1"
    return f"""WITH files AS ({_files_sql(contents, hash_name)}),
leaf AS ({rolled("files", "regexp_replace(path, '[^/]+$', '')")}),
middle AS ({rolled("leaf", "regexp_replace(path, '[^/]+/$', '')")}),
root AS ({rolled("middle", "'./'")}),
manifest AS (
  SELECT 'F' AS path_type, '600' AS permissions, checksum, size, path FROM files
  UNION ALL SELECT 'D', '700', checksum, size, path FROM (FROM leaf UNION ALL FROM middle UNION ALL FROM root))
{then}"""


_SHARD = "substr(checksum, 1, 3) || '/' || substr(checksum, 4, 3) || '/' || substr(checksum, 7, 3) || '/' || substr(checksum, 10)"
_LAYOUT = f"SELECT checksum, max(size) AS size, '.objects/' || {_SHARD} AS path FROM ({_files_sql(_DOCS)}) GROUP BY checksum"
_INVENTORY = f"""SELECT b.checksum, c.checksum AS actual_checksum, '.objects/' || {_SHARD.replace("checksum", "b.checksum")} AS path
  FROM (SELECT checksum, min(path) AS path FROM ({_files_sql(_DOCS)}) GROUP BY checksum) b
  JOIN ({_files_sql(_CURATED)}) c ON b.path = c.path"""
_HISTORY = """SELECT id, previous_id, location, created_at FROM (
  SELECT id, lag(id) OVER (PARTITION BY location ORDER BY created_at, seq) AS previous_id, location, created_at
  FROM (SELECT sha256(event_type) AS id, user_id::VARCHAR AS location, ts AS created_at, event_id AS seq FROM events))
  WHERE id IS DISTINCT FROM previous_id"""
_BASE_FILES = f"WITH base AS ({_rows_sql(_DOCS)}), curated AS ({_rows_sql(_CURATED)}) "
_BASE_TWO = f"WITH base AS ({_manifest_sql(_DOCS)}), curated AS ({_manifest_sql(_CURATED)}) "
_COLUMNS = ", ".join(MANIFEST_COLUMNS)
_TIME = "strftime(created_at, '%Y-%m-%d %H:%M:%S.%g')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "file_manifest": file_manifest,
    "dir_manifest_leaf": directories_of_level(3),
    "dir_manifest_mid": directories_of_level(2),
    "dir_manifest_root": directories_of_level(1),
    "full_manifest": full_manifest,
    "snapshot_id": snapshot_id,
    "manifest_lines": manifest_lines,
    "parsed_manifest": parsed_manifest,
    "directory_sizes": directory_sizes,
    "inventory_id": inventory_id,
    "object_layout": object_layout,
    "path_to_checksum": path_to_checksum,
    "exclude_rollup": exclude_rollup,
    "paths_filter": paths_filter,
    "manifest_additions": manifest_additions,
    "manifest_deletions": manifest_deletions,
    "manifest_unchanged": manifest_unchanged,
    "manifest_difference": manifest_difference,
    "missing_objects": missing_objects,
    "tampered_objects": tampered_objects,
    "transfer_plan": transfer_plan,
    "checkout_plan": checkout_plan,
    "verify_status": verify_status,
    "verify_inventory": verify_inventory,
    "purged_inventory": purged_inventory,
    "duplicate_content": duplicate_content,
    "history_collapse": history_collapse,
    "locations_latest": locations_latest,
    "ancestors": ancestors,
    "ancestors_at_location": ancestors_at_location,
    "revisions": revisions,
    "latest_id": latest_id,
    "catalog_json": catalog_json,
    "checked_log": checked_log,
    "incremental_rehash": incremental_rehash,
    "store_uri_parse": store_uri_parse,
    "digests": digests,
    "md5_manifest": md5_manifest,
    "blake3_manifest": blake3_manifest,
    "blake3_keyed_manifest": blake3_keyed_manifest,
    "blake3_roots": blake3_roots,
    "scan_manifest": _on_files(scan_manifest),
    "scan_excluded": _on_files(scan_excluded),
    "memo_manifest": _on_files(memo_manifest),
    "pulled_manifest": _on_files(pulled_manifest),
    "store_inventory": _on_files(store_inventory),
    "store_purged": _on_files(store_purged),
    "lineage": lineage,
    "streamed_history": streamed_history,
}

ORACLE_SQL: dict[str, str] = {
    "file_manifest": _rows_sql(_DOCS),
    "dir_manifest_leaf": _manifest_sql(_DOCS, then="SELECT path, checksum, size FROM leaf"),
    "dir_manifest_mid": _manifest_sql(_DOCS, then="SELECT path, checksum, size FROM middle"),
    "dir_manifest_root": _manifest_sql(_DOCS, then="SELECT path, checksum, size FROM root"),
    "full_manifest": _manifest_sql(_DOCS),
    "snapshot_id": _manifest_sql(_DOCS, then="SELECT sha256(string_agg(concat_ws(' ', path_type, permissions, checksum, size, path), chr(10) ORDER BY path) || chr(10)) AS id FROM manifest"),
    "manifest_lines": _manifest_sql(_DOCS, then="SELECT concat_ws(' ', path_type, permissions, checksum, size, path) AS line FROM manifest"),
    "parsed_manifest": _manifest_sql(_DOCS),
    "directory_sizes": _manifest_sql(_DOCS, then="SELECT path, size FROM manifest WHERE path_type = 'D'"),
    "inventory_id": f"SELECT sha256('context' || string_agg(checksum || '  ' || path, chr(10) ORDER BY checksum || '  ' || path) || chr(10)) AS id FROM ({_INVENTORY})",
    "object_layout": _LAYOUT,
    "path_to_checksum": f"SELECT path, replace(split_part(path, '.objects/', 2), '/', '') AS checksum FROM ({_LAYOUT})",
    "exclude_rollup": _manifest_sql(f"SELECT * FROM ({_DOCS}) WHERE NOT regexp_matches(path, '^\\./fr/|/src1[0-9]/')"),
    "paths_filter": _manifest_sql(_DOCS, then=f"SELECT {_COLUMNS} FROM manifest WHERE regexp_matches(path, '^(\\.|\\./|/)?(en/src1|de/src0/)')"),
    "manifest_additions": f"{_BASE_TWO} SELECT {_COLUMNS} FROM curated EXCEPT ALL SELECT {_COLUMNS} FROM base",
    "manifest_deletions": f"{_BASE_TWO} SELECT {_COLUMNS} FROM base EXCEPT ALL SELECT {_COLUMNS} FROM curated",
    "manifest_unchanged": f"{_BASE_TWO} SELECT {_COLUMNS} FROM base WHERE path_type = 'F' EXCEPT ALL (SELECT {_COLUMNS} FROM curated EXCEPT ALL SELECT {_COLUMNS} FROM base)",
    "manifest_difference": f"""{_BASE_TWO} SELECT coalesce(a.path, t.path) AS path,
  CASE WHEN a.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'deleted' WHEN a.checksum = t.checksum AND a.size = t.size AND a.permissions = t.permissions THEN 'same' ELSE 'modified' END AS change,
  a.checksum AS actual_checksum, t.checksum AS target_checksum FROM base a FULL JOIN curated t ON a.path = t.path""",
    "missing_objects": f"{_BASE_FILES} SELECT checksum, max(size) AS size FROM curated WHERE checksum NOT IN (SELECT checksum FROM base) GROUP BY checksum",
    "tampered_objects": f"SELECT checksum, size, actual_checksum FROM ({_LAYOUT}) o JOIN (SELECT DISTINCT checksum, actual_checksum FROM ({_INVENTORY})) USING (checksum) WHERE checksum <> actual_checksum",
    "transfer_plan": f"""SELECT o.checksum, o.size, o.path, CASE WHEN i.checksum IS NULL THEN 'missing' ELSE 'tampered' END AS reason
  FROM ({_LAYOUT}) o LEFT JOIN ({_INVENTORY}) i USING (checksum) WHERE i.checksum IS NULL OR i.checksum <> i.actual_checksum""",
    "checkout_plan": f"""{_BASE_TWO} SELECT t.*, CASE WHEN t.path_type = 'D' THEN 'mkdir' WHEN b.path IS NOT NULL THEN 'overwrite' ELSE 'copy' END AS action,
  CASE WHEN t.path_type = 'D' THEN NULL WHEN t.checksum[1] >= 'c' THEN 'missing' WHEN b.path IS NOT NULL THEN 'conflict' END AS error
  FROM (SELECT {_COLUMNS} FROM curated EXCEPT ALL SELECT {_COLUMNS} FROM base) t LEFT JOIN base b ON b.path = t.path
  WHERE t.path_type = 'F' OR b.path IS NULL""",
    "verify_status": f"SELECT o.checksum, i.actual_checksum, CASE WHEN i.actual_checksum = o.checksum THEN 'OK' ELSE 'FAILED' END AS status FROM ({_LAYOUT}) o LEFT JOIN ({_INVENTORY}) i ON o.checksum = i.checksum",
    "verify_inventory": f"SELECT path, checksum, actual_checksum FROM ({_INVENTORY}) WHERE checksum <> actual_checksum",
    "purged_inventory": f"SELECT checksum, actual_checksum, path FROM ({_INVENTORY}) WHERE checksum = actual_checksum",
    "duplicate_content": f"SELECT checksum, count(*) AS copies, (sum(size) - max(size))::BIGINT AS saved_bytes FROM ({_files_sql(_DOCS)}) GROUP BY checksum HAVING count(*) > 1",
    "history_collapse": _HISTORY,
    "locations_latest": f"""WITH h AS ({_HISTORY}) SELECT a.id, a.location, a.previous_id, a.created_at
  FROM h a LEFT JOIN h b ON a.location = b.location AND a.created_at < b.created_at WHERE b.id IS NULL""",
    "ancestors": f"SELECT previous_id AS id, location, created_at FROM ({_HISTORY}) WHERE id = sha256('{PURCHASE}') AND previous_id IS NOT NULL",
    "ancestors_at_location": f"SELECT previous_id AS id, location, created_at FROM ({_HISTORY}) WHERE id = sha256('{PURCHASE}') AND previous_id IS NOT NULL AND location = '{USER}'",
    "revisions": f"SELECT id, previous_id, created_at FROM ({_HISTORY}) WHERE location = '{USER}'",
    "latest_id": f"SELECT id FROM ({_HISTORY}) WHERE location = '{USER}' ORDER BY created_at DESC, id LIMIT 1",
    "catalog_json": f"SELECT json_object('created_at', {_TIME}, 'id', id, 'location', location, 'previous_id', previous_id)::VARCHAR AS json FROM ({_HISTORY})",
    "checked_log": "SELECT 'push' AS event, sha256(event_type) AS id, user_id::VARCHAR AS location, ts AS created_at, event_id AS seq FROM events",
    "incremental_rehash": f"""SELECT n.path, n.size, coalesce(o.checksum, n.checksum) AS checksum, o.checksum IS NOT NULL AS reused
  FROM (SELECT path, sha256(content) AS checksum, strlen(content)::BIGINT AS size, changed FROM ({_CURATED})) n
  LEFT JOIN ({_files_sql(_DOCS)}) o ON n.path = o.path AND n.size = o.size AND n.changed = 0""",
    "store_uri_parse": r"""SELECT page_id, nullif(regexp_extract(url, '^([a-z0-9]*)://', 1), '') AS protocol,
  split_part(regexp_replace(url, '^[^:]*://', ''), '/', 1) AS bucket, regexp_extract(regexp_replace(url, '^[^:]*://', ''), '^[^/]*/(.*)$', 1) AS base_dir FROM pages""",
    "digests": f"SELECT path, md5(content) AS md5, sha1(content) AS sha1, sha256(content) AS sha256 FROM ({_DOCS})",
    "md5_manifest": _manifest_sql(_DOCS, "md5"),
    "blake3_roots": f"SELECT * FROM (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in _TREE_ROOTS.items())}) t(kind, checksum)",
    "scan_manifest": _manifest_sql(_DOCS),
    "scan_excluded": _manifest_sql(f"SELECT * FROM ({_DOCS}) WHERE NOT regexp_matches(path, '^\\./fr/|/src1[0-9]/')"),
    "memo_manifest": _manifest_sql(_DOCS),
    "pulled_manifest": _manifest_sql(_DOCS),
    "store_inventory": f"SELECT path, checksum, checksum AS actual_checksum FROM ({_LAYOUT})",
    "store_purged": f"SELECT path, checksum, actual_checksum FROM ({_INVENTORY}) WHERE checksum = actual_checksum",
    "lineage": f"""WITH RECURSIVE h AS ({_HISTORY}),
  before AS (
    SELECT sha256('{PURCHASE}') AS id, 0 AS hops
    UNION SELECT h.previous_id, b.hops + 1 FROM before b JOIN h ON h.id = b.id WHERE h.previous_id IS NOT NULL AND b.hops < 64)
SELECT id, min(hops)::INTEGER AS hops FROM before GROUP BY id HAVING min(hops) > 0""",
    "streamed_history": _HISTORY,
}
