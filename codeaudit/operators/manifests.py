"""Declared dependencies out of manifest files.

A manifest is read inside its own row: the text is cut at its section headers, each section into
its lines or string arrays. Nothing is shuffled before the declarations are de-duplicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeaudit.functions.text import merged, numbered_lines, strip
from codeaudit.sources.files import SKIP_MANIFESTS, only_tracked, outside

# --- fixed values: file name -> ecosystem, in the order of discovery ----------
MANIFESTS = {
    "requirements.txt": "pypi", "pyproject.toml": "pypi", "package.json": "npm",
    "Gemfile": "rubygems", "Cargo.toml": "crates", "Pipfile": "pypi",
}
JSON_SECTIONS = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies"]
# ------------------------------------------------------------------------------

VERSION_SIGN = r"[<>=!~]{1,2}"
TOML_HEADER = r"\[{1,2}[^\[\]\n]*\]{1,2}[ \t]*(?:#[^\n]*)?$"
STRING_ARRAY = (r"(?m)^[ \t]*(?:KEY)[ \t]*=[ \t]*\["
                r"((?:[^\"'\]#]++|\"[^\"\n]*+\"|'[^'\n]*+'|#[^\n]*+)*+)\]")
ARRAY_ITEM = r"#[^\n]*|\"[^\"\n]*\"|'[^'\n]*'"
TOML_KEY = r"^([A-Za-z0-9_-]+)\s*="
KEEP = ["repo_id", "path"]


def manifest_files(files: DataFrame) -> DataFrame:
    """Manifests with ``manifest_rank``: by kind, the root's before others."""
    at_root = F.col("path") == F.col("base")
    rank = F.array_position(F.array(*[F.lit(n) for n in MANIFESTS]), F.col("base")).cast("int")
    return (files.filter(F.col("base").isin(list(MANIFESTS)))
            .withColumn("manifest_rank", rank * 2 - F.when(at_root, 1).otherwise(0)))


def in_manifest_scope(rows: DataFrame, names: DataFrame, tracked: DataFrame | None = None,
                      git_repos: DataFrame | None = None) -> DataFrame:
    """Rows of manifests in scope, by (repo_id, path, base); ``names`` are all manifests' keys.

    An untracked manifest at the root of a git repository hides all manifests of its kind there.
    """
    at_root = F.col("path") == F.col("base")
    kept = only_tracked(rows, tracked, git_repos, at_root | outside(
        F.col("path"), SKIP_MANIFESTS, dot_parts=True))
    if tracked is None or git_repos is None:
        return kept
    hidden = (names.filter(at_root)
              .join(git_repos.select("repo_id").distinct(), "repo_id", "left_semi")
              .join(tracked.select("repo_id", "path").distinct(), KEEP, "left_anti"))
    return kept.join(hidden.select("repo_id", "base"), ["repo_id", "base"], "left_anti")


def _declared(name: Column, requested: Column, position: Column) -> Column:
    return F.struct(F.lower(name).alias("package"),
                    F.nullif(strip(requested), F.lit("")).alias("requested"),
                    position.cast("bigint").alias("ord"))


def split_requirement(spec: Column) -> tuple[Column, Column]:
    """Name and version specifier of a requirement without comment."""
    plain = strip(F.regexp_extract(spec, r"^([^;]*)", 1))
    bare = F.regexp_replace(plain, r"\[.*\]", "")
    name = strip(F.regexp_extract(bare, r"^(.*?)(?:" + VERSION_SIGN + r".*)?$", 1))
    return name, F.regexp_extract(bare, r"(" + VERSION_SIGN + r".*)$", 1)


def requirements(content: Column) -> Column:
    def one(n: Column) -> Column:
        spec = strip(F.regexp_extract(n["text"], r"^([^#]*)", 1))
        return _declared(*split_requirement(spec), n["line_no"])

    wanted = F.filter(numbered_lines(content), lambda n: n["text"].rlike(
        r"^\s*(?!#|-r|--requirement|-e|git\+)\S"))
    return F.transform(wanted, one)


def toml_sections(content: Column, header: str) -> Column:
    """Array of (section_no, section, body): the text cut in front of every header line."""
    def section(text: Column, i: Column) -> Column:
        first = strip(F.regexp_extract(text, r"^([^\n]*)", 1))
        has_header = first.startswith("[")
        return F.struct(
            i.alias("section_no"), F.when(has_header, first).otherwise("").alias("section"),
            F.when(has_header, F.regexp_replace(text, r"^[^\n]*\n?", "")).otherwise(text)
             .alias("body"))

    return F.transform(F.split(content, r"(?m)^(?=[ \t]*" + header + ")", -1), section)


def _key_values(sections: Column, key: str) -> Column:
    """Declarations of the form ``name = version`` or ``name = {version = ...}``."""
    def lines(s: Column) -> Column:
        return F.transform(numbered_lines(s["body"]), lambda n: _declared(
            F.regexp_extract(strip(n["text"]), key, 1),
            F.regexp_extract(n["text"], r"=\s*(?:\{.*?version\s*=\s*)?[\"']([^\"']*)[\"']", 1),
            s["section_no"].cast("bigint") * 1_000_000 + n["line_no"]))

    return F.flatten(F.transform(sections, lines))


def pyproject(content: Column) -> Column:
    """Project dependencies, optional groups, and poetry's tables but for python itself."""
    sections = toml_sections(content, TOML_HEADER)

    def titled(pattern: str) -> Column:
        return F.filter(sections, lambda s: F.regexp_replace(
            s["section"], r"#.*$|[\s\"'\[\]]", "").rlike(pattern))

    def listed(title: str, key: str, shift: int) -> Column:
        texts = F.transform(titled(title), lambda s: F.transform(
            F.regexp_extract_all(s["body"], F.lit(STRING_ARRAY.replace("KEY", key)), F.lit(1)),
            lambda a: F.regexp_extract_all(a, F.lit(ARRAY_ITEM), F.lit(0))))
        items = F.filter(F.flatten(F.flatten(texts)), lambda s: ~s.startswith("#"))
        return F.transform(items, lambda item, i: _declared(
            *split_requirement(F.substring(item, F.lit(2), F.length(item) - 2)), i + shift))

    tables = titled(r"^tool\.poetry\.(?:dependencies|dev-dependencies|group\.[^.]+\.dependencies)$")
    poetry = F.transform(
        F.filter(_key_values(tables, r"^[\"']?([A-Za-z0-9_.-]+)[\"']?\s*="),
                 lambda d: d["package"] != "python"),
        lambda d: _declared(d["package"], d["requested"], d["ord"] + 1_000_000))
    return merged(listed(r"^project$", "dependencies", 0),
                  listed(r"^project\.optional-dependencies$", r"[A-Za-z0-9_\"'-]+", 100_000),
                  poetry)


def package_json(content: Column) -> Column:
    """All keys of the four sections; a text that is no JSON declares nothing."""
    parsed = F.from_json(content, ", ".join(f"`{s}` map<string,string>" for s in JSON_SECTIONS))
    entries = merged(*[F.map_entries(parsed[s]) for s in JSON_SECTIONS])
    return F.transform(entries, lambda e, i: _declared(e["key"], e["value"], i))


def gemfile(content: Column) -> Column:
    gem = r"^\s*gem\s+['\"]([^'\"]+)['\"]"
    return F.transform(numbered_lines(content), lambda n: _declared(
        F.regexp_extract(n["text"], gem, 1),
        F.regexp_extract(n["text"], gem + r"\s*,\s*['\"]([^'\"]+)['\"]", 2), n["line_no"]))


def cargo(content: Column) -> Column:
    return _key_values(F.filter(toml_sections(content, r"\["),
                                lambda s: s["section"].contains("dependencies")), TOML_KEY)


def pipfile(content: Column) -> Column:
    return _key_values(F.filter(toml_sections(content, r"\["), lambda s: s["section"].isin(
        "[packages]", "[dev-packages]")), TOML_KEY)


PARSERS = {"requirements.txt": requirements, "pyproject.toml": pyproject,
           "package.json": package_json, "Gemfile": gemfile, "Cargo.toml": cargo,
           "Pipfile": pipfile}


def ecosystem_of(package: Column, base: Column) -> Column:
    """By manifest; for an unknown file a scoped name is npm's, any other PyPI's."""
    known = F.when(base == "requirements.txt", "pypi")
    for name, eco in MANIFESTS.items():
        known = known.when(base == name, eco)
    return known.when(package.rlike(r"^@[^/]+/"), "npm").otherwise("pypi")


def declared_dependencies(files: DataFrame, tracked: DataFrame | None = None,
                          git_repos: DataFrame | None = None) -> DataFrame:
    """(repo_id, manifest, manifest_rank, package, ecosystem, requested, ord) of all manifests."""
    found = manifest_files(files)
    base, content = F.col("base"), F.col("content")
    parsed = F.when(base == "requirements.txt", requirements(content))
    for name, parser in PARSERS.items():
        parsed = parsed.when(base == name, parser(content))
    rows = found.select("repo_id", "path", "base", "manifest_rank", F.inline(parsed))
    rows = in_manifest_scope(rows.filter(F.col("package") != ""),
                             found.select("repo_id", "path", "base"), tracked, git_repos)
    return rows.select(
        "repo_id", F.col("path").alias("manifest"), "manifest_rank", "package",
        ecosystem_of(F.col("package"), base).alias("ecosystem"), "requested", "ord")


def unique_dependencies(deps: DataFrame) -> DataFrame:
    """One row per (repo, package, ecosystem): the first by manifest, depth, path, position.

    A minimum, so tasks combine before the shuffle however often a package is declared.
    """
    depth = F.size(F.split("manifest", "/"))
    first = F.min_by(F.struct("manifest", "manifest_rank", "requested", "ord"),
                     F.struct("manifest_rank", depth.alias("depth"), "manifest", "ord"))
    return (deps.filter(F.col("package").isNotNull())
            .groupBy("repo_id", "package", "ecosystem").agg(first.alias("first"))
            .select("repo_id", "package", "ecosystem", "first.*"))
