"""Filters and differences of manifests."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MANIFEST_COLUMNS

# The folders that the macros %system% and %common% leave out.
SYSTEM_EXCLUDES = "/vscode/|/dev/|/proc/|/sys/|/tmp/|/var/run/|/run/|/mnt/|/media/|/lost+found/|/var/snap/lxd/common/ns/shmounts/|/var/snap/lxd/common/ns/mntns/|/var/lib/lxcfs/"
COMMON_EXCLUDES = ".cache|.git|.DS_Store|.vscode-server|.dbus|.gvfs|.local/share/gvfs-metadata|.local/share/Trash|.Trash|node_modules|Trash-1000"


def expand_excludes(pattern: str, cache_dir: str = "", system: str = SYSTEM_EXCLUDES, common: str = COMMON_EXCLUDES) -> tuple[str, bool]:
    """The pattern with its macros expanded (to other lists, if given), and whether links may be followed (%system% forbids it)."""
    follow = "%system%" not in pattern
    system = "|".join([f"({system})", f"{os.path.expanduser('~')}/.cache/", *([cache_dir] if cache_dir else [])])
    return pattern.replace("%system%", f"(^({system}))").replace("%common%", f"(/({common})($|/))"), follow


def exclude(rows: DataFrame, pattern: str, path: str | Column = "path") -> DataFrame:
    """Rows whose (absolute) path has no match of the pattern; before hashing, so that rollups leave them out."""
    pattern, _ = expand_excludes(pattern)
    path = F.col(path) if isinstance(path, str) else path
    return rows.filter(~path.rlike(pattern)) if pattern else rows


def paths_pattern(paths: str) -> str:
    """The pattern of a comma-separated list of path prefixes, which are patterns themselves."""
    names = [p.removeprefix("./") for p in paths.removeprefix("'").removesuffix("'").split(",")]
    joined = "|".join(names).lstrip("|")
    return rf"^(\.|\./|/)?({joined})" if joined else ""


def only_paths(rows: DataFrame, paths: str) -> DataFrame:
    pattern = paths_pattern(paths)
    return rows.filter(F.col("path").rlike(pattern)) if pattern else rows


def only_files(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("path_type") == "F")


def only_directories(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("path_type") == "D")


def additions(actual: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of the target that the actual manifest lacks, by all five columns."""
    return target.select(*MANIFEST_COLUMNS).join(actual.select(*MANIFEST_COLUMNS), MANIFEST_COLUMNS, "left_anti")


def deletions(actual: DataFrame, target: DataFrame) -> DataFrame:
    """Rows that only the actual manifest has; a checkout leaves them alone."""
    return additions(target, actual)


def unchanged(actual: DataFrame, target: DataFrame) -> DataFrame:
    """File rows of the actual manifest that are not among the additions (so also those of which the target has none)."""
    return additions(additions(actual, target), only_files(actual))


def difference(actual: DataFrame, target: DataFrame) -> DataFrame:
    """path, change (added, deleted, modified, same) and both checksums, with one join on the path."""
    a = actual.select("path", F.struct("path_type", "permissions", "checksum", "size").alias("a"))
    t = target.select("path", F.struct("path_type", "permissions", "checksum", "size").alias("t"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("t").isNull(), "deleted").when(F.col("a") == F.col("t"), "same").otherwise("modified")
    return a.join(t, "path", "full_outer").select("path", change.alias("change"), F.col("a.checksum").alias("actual_checksum"), F.col("t.checksum").alias("target_checksum"))
