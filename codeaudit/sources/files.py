"""The files table: reading repositories, tracked files, directory filters, languages, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeaudit.functions.text import base_name, extension
from codeaudit.model import lookup
from codeaudit.sources.tree import read_tree

# --- fixed values -----------------------------------------------------------
REPORT_LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "JSX", ".tsx": "TSX",
    ".go": "Go", ".rb": "Ruby", ".rs": "Rust", ".java": "Java", ".yml": "YAML", ".yaml": "YAML",
}
CODE_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".mjs": "javascript", ".cjs": "javascript",
}
SCANNABLE = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rb", ".rs", ".java", ".yml", ".yaml", ".json",
    ".toml", ".cfg", ".ini", ".env", ".md", ".txt",
]
SKIP_INVENTORY = ["node_modules", ".venv", "venv", "env", "__pycache__"]
SKIP_STRUCTURE = [
    "node_modules", ".venv", "venv", "__pycache__", ".git", ".next", "dist", "build", ".tox",
    ".mypy_cache",
]
SKIP_COST = [
    "node_modules", ".venv", "venv", "__pycache__", ".git", "dist", "build", ".tox",
    ".mypy_cache", ".pytest_cache", "tests", "test", "fixtures", "__tests__", "__mocks__",
    ".next", ".nuxt", "out",
]
SKIP_PROFILE = [
    "node_modules", ".venv", "venv", "__pycache__", ".git", "dist", "build", ".tox",
    ".mypy_cache", ".pytest_cache", "tests", "test", "fixtures", "__tests__", "__mocks__",
]
SKIP_MANIFESTS = ["node_modules", ".venv", "venv", "__pycache__"]
SKIP_HTML = ["node_modules", ".next", ".venv"]
# ----------------------------------------------------------------------------


def read_repositories(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root/<repo_id>/...`` as rows of whole text, with all their names, hidden ones too.

    Bytes that are no UTF-8 are dropped, blank files are skipped. See ``sources.tree``: one listing, one
    task per range of paths; what couldn't be read is in ``unreadable``.
    """
    return _texts(read_tree(spark, root))


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """Files of repositories packed as ``root/**/<repo_id>.tar`` (also ``.gz``, ``.bz2``, ``.xz``, ``.tgz``)
    or ``.zip``, with all their names. One archive is streamed by one task, member by member; a leading
    ``./`` is dropped. What couldn't be read is in ``unreadable``.
    """
    return _texts(read_tree(spark, root, archives=True))


def unreadable(spark: SparkSession, root: str, archives: bool = False) -> DataFrame:
    """(repo_id, path, error) of files, archives and members that the two readers leave out."""
    return read_tree(spark, root, archives).filter("error is not null").drop("content")


def _texts(rows: DataFrame) -> DataFrame:
    return with_names(rows.filter(F.col("content").rlike(r"\S")).drop("error"))


def with_names(files: DataFrame) -> DataFrame:
    """Add ``ext`` and ``base``; store them, so that scans prune by them."""
    return (files.withColumn("ext", extension(F.col("path")))
                 .withColumn("base", base_name(F.col("path"))))


def outside(path: Column, directories: Sequence[str], dot_parts: bool = False,
            whole_path: bool = True) -> Column:
    """True where no part of the path is one of ``directories`` (nor starts with a dot)."""
    parts = F.split(path, "/")
    if not whole_path:
        parts = F.slice(parts, 1, F.size(parts) - 1)
    keep = ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in directories]))
    if dot_parts:
        keep = keep & ~F.exists(parts, lambda p: p.startswith("."))
    return F.coalesce(keep, F.lit(True))


def without_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    """Leave out an own tool's files by their path prefix."""
    return rows.filter(~F.col("path").startswith(prefix))


def exclude_paths(rows: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Configured excludes: drop rows whose path contains a named directory or file."""
    names = [p.rstrip("/") for p in patterns]
    return rows.filter(outside(F.col("path"), names)) if names else rows


def only_tracked(rows: DataFrame, tracked: DataFrame | None, git_repos: DataFrame | None,
                 otherwise: Column) -> DataFrame:
    """Tracked rows of git repositories, and rows of the others that satisfy ``otherwise``.

    ``rows`` is anything keyed by (repo_id, path). Give it narrow rows (keys, findings) rather
    than file contents: then only keys are shuffled. Both tables are joined as flags, so ``rows``
    is computed once. Without tables of tracked files only the condition applies.
    """
    if tracked is None or git_repos is None:
        return rows.filter(otherwise)
    repos = git_repos.select("repo_id", F.lit(True).alias("_git")).distinct()
    names = tracked.select("repo_id", "path", F.lit(True).alias("_tracked")).distinct()
    keep = F.when(F.col("_git"), F.coalesce("_tracked", F.lit(False))).otherwise(otherwise)
    return (rows.join(repos, "repo_id", "left").join(names, ["repo_id", "path"], "left")
            .filter(keep).select(*rows.columns))


def with_language(files: DataFrame, keep_others: bool = False) -> DataFrame:
    """Code language by extension; files without one are dropped unless ``keep_others``."""
    rows = files.withColumn("lang", lookup(CODE_LANGUAGES, F.col("ext")))
    return rows if keep_others else rows.filter(F.col("lang").isNotNull())


def inventory(files: DataFrame, tracked: DataFrame | None = None,
              git_repos: DataFrame | None = None) -> DataFrame:
    """Per repository: sorted report languages and the number of scannable files."""
    rows = only_tracked(files.select("repo_id", "path", "ext"), tracked, git_repos,
                        outside(F.col("path"), SKIP_INVENTORY, dot_parts=True, whole_path=False))
    return rows.groupBy("repo_id").agg(
        F.array_sort(F.collect_set(lookup(REPORT_LANGUAGES, F.col("ext")))).alias("languages"),
        F.count_if(F.col("ext").isin(SCANNABLE)).alias("files_scanned"))

