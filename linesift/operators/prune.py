"""File pruning: excluded directories, extensions, name globs, extension groups.

All exclusion lists are small configuration values: they become literal
arrays / regexes in one filter, so pruning is a narrow ``Filter`` over the
file list, evaluated before any file body is read.  An exclusion list held in
a table is applied with a broadcast anti join after a size check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linesift.functions.regex import glob_to_java
from linesift.functions.text import basename, extension, parent_dirs

# The extension groups offered by the settings window.
EXT_GROUPS = {
    "images": [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico"],
    "executables": [".exe", ".dll", ".so", ".dylib", ".class", ".obj", ".o"],
    "archives": [".zip", ".tar", ".gz", ".rar", ".7z"],
    "temp_logs": [".log", ".bak", ".tmp", ".pyc", ".pyo"],
}

MAX_BROADCAST_EXCLUSIONS = 100_000  # bound for an exclusion table sent to every task


def normalize_list(value) -> list[str]:
    """Trim items, drop empties; a bare string is a one-item list; anything else is empty."""
    if isinstance(value, str):
        value = [value]
    if not isinstance(value, (list, tuple)):
        return []
    return [str(v).strip() for v in value if str(v).strip()]


def normalize_extensions(value) -> list[str]:
    """As ``normalize_list``, plus a leading dot and lower case."""
    return [(e if e.startswith(".") else "." + e).lower() for e in normalize_list(value)]


def split_comma_list(text: str) -> list[str]:
    """``" .git,  node_modules, , bin "`` -> ``['.git', 'node_modules', 'bin']``."""
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def normalize_list_col(c: Column, extensions: bool = False) -> Column:
    """Column form of the list normalising: ``array<string>`` in, normalised array out."""
    trimmed = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    if not extensions:
        return trimmed
    return F.transform(trimmed, lambda x: F.lower(F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x))))


@dataclass(frozen=True)
class Exclusions:
    dirs: tuple[str, ...] = ()
    exts: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()

    @staticmethod
    def of(dirs=None, exts=None, globs=None) -> "Exclusions":
        return Exclusions(tuple(normalize_list(dirs)), tuple(normalize_extensions(exts)), tuple(g for g in (globs or []) if g))

    def effective(self, dirs=None, exts=None, globs=None) -> "Exclusions":
        """Call arguments replace the defaults when not ``None`` (so ``[]`` clears them); globs have no default."""
        return Exclusions(
            tuple(normalize_list(dirs)) if dirs is not None else self.dirs,
            tuple(normalize_extensions(exts)) if exts is not None else self.exts,
            tuple(g for g in (globs or []) if g),
        )

    def union(self, dirs=None, exts=None) -> "Exclusions":
        """Configuration lists merged with command-line lists (set union, order not kept)."""
        d = sorted(set(self.dirs) | set(normalize_list(dirs or [])))
        e = sorted(set(self.exts) | set(normalize_extensions(exts or [])))
        return Exclusions(tuple(d), tuple(e), self.globs)


def with_path_parts(files: DataFrame, rel_path: str = "file_path") -> DataFrame:
    """Add ``base_name``, ``ext`` and ``dirs`` (directories below the root) to a file list."""
    return files.withColumns(
        {
            "base_name": basename(F.col(rel_path)),
            "dirs": parent_dirs(F.col(rel_path)),
        }
    ).withColumn("ext", extension(F.col("base_name")))


def keep_predicate(ex: Exclusions) -> Column:
    """``True`` for files that survive the exclusions (needs ``dirs``, ``ext``, ``base_name``)."""
    cond = F.lit(True)
    if ex.dirs:
        cond = cond & ~F.arrays_overlap(F.col("dirs"), F.array(*[F.lit(d) for d in ex.dirs]))
    if ex.exts:
        cond = cond & ~F.col("ext").isin(list(ex.exts))
    for g in ex.globs:
        cond = cond & ~F.col("base_name").rlike(glob_to_java(g))
    return cond


def prune(files: DataFrame, ex: Exclusions) -> DataFrame:
    """Drop excluded files; ``files`` must carry ``dirs``, ``ext`` and ``base_name``."""
    return files.where(keep_predicate(ex))


def ext_groups_frame(spark: SparkSession) -> DataFrame:
    rows = [(g, e) for g, exts in EXT_GROUPS.items() for e in exts]
    return spark.createDataFrame(rows, "grp string, ext string")


def toggle_groups(current: list[str], ticked: list[str] = (), unticked: list[str] = ()) -> list[str]:
    """Ticking a group appends its missing members; unticking removes them."""
    out = normalize_extensions(current)
    for g in ticked:
        out += [e for e in EXT_GROUPS[g] if e not in out]
    for g in unticked:
        out = [e for e in out if e not in EXT_GROUPS[g]]
    return out


def prune_by_table(files: DataFrame, excluded_exts: DataFrame) -> DataFrame:
    """Anti join of files against an extension table; broadcast only after its size is checked."""
    ex = excluded_exts.select(F.lower("ext").alias("ext")).distinct()
    n = ex.limit(MAX_BROADCAST_EXCLUSIONS + 1).count()
    right = F.broadcast(ex) if n <= MAX_BROADCAST_EXCLUSIONS else ex
    return files.join(right, "ext", "left_anti")
