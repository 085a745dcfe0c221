"""Imports, functions and classes of Python and JavaScript files, by regular expressions.

Each extraction works inside one file's row: a match yields its line, its groups and, where a
block matters, the block's text through a look-ahead, so that nested blocks are found as well. Argument
lists are made plain before, see ``functions.calls``, so three levels of parentheses are all there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeaudit.functions.calls import with_heads
from codeaudit.functions.text import let, matches, merged, newlines, strip
from codeaudit.sources.files import SKIP_STRUCTURE, only_tracked, outside, with_language

# --- fixed values: the JavaScript forms that are recognised -------------------------------
JS_NAMED = r"import\s+\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]"
JS_DEFAULT = r"import\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]"
JS_STAR = r"import\s+\*\s+as\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]"
JS_REQUIRE = (r"(?:const|let|var)\s+(?:\{([^}]+)\}|(\w+))\s*=\s*require\s*\(\s*['\"]([^'\"]+)"
              r"['\"]\s*\)")
JS_FUNCTION = (r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)")
JS_ARROW = (r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(?([^)]*?)\)?\s*=>")
JS_CLASS = r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?"
# ------------------------------------------------------------------------------------------
ARGUMENTS = r"\(((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+)\)"
PY_IMPORT = r"(?m)^[ \t]*import[ \t]+([\w.]+[^\n#;]*)"
PY_FROM = (r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]*"
           r"(?:\(([^)]*)\)|((?:\\\n|[^\n#;(])+))")
BLOCK = r"(?=((?:\n(?:\1[ \t]+\S[^\n]*|[ \t]*(?=\n|\z)))*+))"
PY_FUNCTION = (r"(?m)^([ \t]*)((?:@[^\n]*\n[ \t]*)*+)(async[ \t]+)?def[ \t]+(\w+)[ \t]*"
               + ARGUMENTS + r"[^\n]*" + BLOCK)
PY_CLASS = (r"(?m)^([ \t]*)class[ \t]+(\w+)[ \t]*(?:" + ARGUMENTS + r")?[ \t]*:[^\n]*"
            + BLOCK)
PY_METHOD = r"(?m)^([ \t]+)(?:async[ \t]+)?def[ \t]+(\w+)"


def _named(text: Column) -> Column:
    """Comma-separated pieces, trimmed, empty ones dropped."""
    pieces = F.transform(F.split(text, ","), strip)
    return F.filter(pieces, lambda p: p != "")


def _before_as(names: Column) -> Column:
    return F.transform(names, lambda n: strip(F.regexp_extract(n, r"(?s)^(.*?)(?:\s+as\s.*)?$", 1)))


def _flat(text: Column) -> Column:
    """Without comments and line continuations."""
    return F.regexp_replace(F.regexp_replace(text, r"#[^\n]*", ""), r"\\\n", " ")


def _strings(*names: Column) -> Column:
    return F.array(*names).cast("array<string>")


def _import(kind: int, m: Column, module: Column, names: Column, alias: Column | None = None,
            is_default: Column | bool = False) -> Column:
    default = is_default if isinstance(is_default, Column) else F.lit(is_default)
    return F.struct(
        m["line"].alias("line_no"), module.alias("module"), names.alias("names"),
        (F.lit(None) if alias is None else alias).cast("string").alias("alias"),
        default.alias("is_default"), F.lit(kind).alias("kind"))


def python_imports(content: Column) -> Column:
    """Array of import statements; ``import a, b`` yields one per module."""
    def plain(m: Column) -> Column:
        return F.transform(_named(m["groups"][0]), lambda item: _import(
            1, m, F.regexp_extract(item, r"^([\w.]+)", 1), _strings(),
            F.nullif(F.regexp_extract(item, r"\sas\s+(\w+)", 1), F.lit(""))))

    def named(m: Column) -> Column:
        module, inner, bare = (m["groups"][i] for i in range(3))
        return _import(2, m, F.regexp_replace(module, r"^\.+", ""),
                       _before_as(_named(_flat(F.concat(inner, bare)))))

    return merged(F.flatten(F.transform(matches(content, PY_IMPORT, 1), plain)),
                  F.transform(matches(content, PY_FROM, 3), named))


def script_imports(content: Column) -> Column:
    """Array of import statements and require calls."""
    def split_as(name: Column) -> Column:
        return strip(F.split_part(name, F.lit(" as "), F.lit(1)))

    def required(m: Column) -> Column:
        inner, name, module = (m["groups"][i] for i in range(3))
        return _import(6, m, module, _named(inner), F.nullif(name, F.lit("")), inner == "")

    return merged(
        F.transform(matches(content, JS_NAMED, 2), lambda m: _import(
            3, m, m["groups"][1], F.transform(_named(m["groups"][0]), split_as))),
        F.transform(matches(content, JS_DEFAULT, 2), lambda m: _import(
            4, m, m["groups"][1], _strings(), m["groups"][0], True)),
        F.transform(matches(content, JS_STAR, 2), lambda m: _import(
            5, m, m["groups"][1], _strings(), m["groups"][0])),
        F.transform(matches(content, JS_REQUIRE, 3), required))


def _by_language(code: DataFrame, python: Column, script: Column) -> DataFrame:
    return code.select("repo_id", "path", "lang", F.inline(
        F.when(F.col("lang") == "python", python).otherwise(script)))


def imports(code: DataFrame) -> DataFrame:
    """(repo_id, path, lang, line_no, module, names, alias, is_default, kind), in one pass."""
    content = F.col("content")
    return _by_language(code, python_imports(content), script_imports(content))


def _python_params(arguments: Column) -> Column:
    """Plain positional names: what follows a slash and precedes a star, without annotations."""
    flat = _flat(arguments)
    for _ in range(2):
        flat = F.regexp_replace(flat, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "")
    flat = F.regexp_extract(flat, r"(?s)^([^*]*)", 1)
    flat = F.element_at(F.split(flat, r"/\s*(?:,|$)"), -1)
    return F.transform(_named(flat), lambda p: F.regexp_extract(p, r"^(\w*)", 1))


def _function(name: Column, params: Column, start: Column, end: Column, is_async: Column,
              exported: Column, decorators: Column) -> Column:
    return F.struct(name.alias("name"), params.alias("params"), start.alias("start_line"),
                    end.cast("int").alias("end_line"), is_async.alias("is_async"),
                    exported.alias("is_exported"), decorators.alias("decorators"))


def python_functions(content: Column) -> Column:
    """Array of functions and methods with parameters, span, async mark, plain decorators."""
    def function(m: Column) -> Column:
        decor, is_async, name, args, body = (m["groups"][i] for i in range(1, 6))
        start = m["line"] + newlines(decor)
        simple = F.filter(F.regexp_extract_all(decor, F.lit(r"@([^\n]*)"), F.lit(1)),
                          lambda d: d.rlike(r"^[\w.]+\s*$"))
        end = m["line"] + newlines(m["match"]) + newlines(F.regexp_replace(body, r"\s+\z", ""))
        return _function(name, _python_params(args), start, end, is_async != "", F.lit(False),
                         F.transform(simple, strip))

    return F.transform(matches(content, PY_FUNCTION, 6), function)


def _script_params(arguments: Column) -> Column:
    return F.transform(_named(arguments), lambda p: strip(F.split_part(p, F.lit(":"), F.lit(1))))


def script_functions(content: Column) -> Column:
    """Array of declarations and arrow functions. ``export`` counts where it stands shortly before
    the matched text, as for declarations, or starts it, as for arrows."""
    def declared(m: Column) -> Column:
        near = F.concat(F.right(m["before"], F.lit(10)), m["match"])
        return _function(m["groups"][0], _script_params(m["groups"][1]), m["line"], F.lit(0),
                         near.contains("async"),
                         F.right(m["before"], F.lit(20)).contains("export"), _strings())

    def arrow(m: Column) -> Column:
        around = F.concat(F.right(m["before"], F.lit(10)), F.left(m["match"], F.lit(10)))
        return _function(m["groups"][0], _script_params(m["groups"][1]), m["line"], F.lit(0),
                         F.lit(False), strip(around).startswith("export"), _strings())

    return merged(F.transform(matches(content, JS_FUNCTION, 2, before=True), declared),
                  F.transform(matches(content, JS_ARROW, 2, before=True), arrow))


def functions(code: DataFrame) -> DataFrame:
    """(repo_id, path, lang, name, params, start_line, end_line, is_async, is_exported,
    decorators)."""
    code = with_heads(code, F.col("lang") == "python", "def")
    return _by_language(code, python_functions(F.col("heads")), script_functions(F.col("content")))


def _class(name: Column, bases: Column, methods: Column, start: Column) -> Column:
    return F.struct(name.alias("name"), bases.alias("bases"), methods.alias("methods"),
                    start.alias("start_line"))


def python_classes(content: Column) -> Column:
    """Array of classes with plain bases and the methods defined directly in their block."""
    def methods_of(body: Column) -> Column:
        defs = F.arrays_zip(
            F.regexp_extract_all(body, F.lit(PY_METHOD), F.lit(1)).alias("indent"),
            F.regexp_extract_all(body, F.lit(PY_METHOD), F.lit(2)).alias("name"))
        return let(F.regexp_extract(body, r"\n([ \t]+)\S", 1), lambda indent: F.transform(
            F.filter(defs, lambda d: d["indent"] == indent), lambda d: d["name"]))

    def one(m: Column) -> Column:
        name, args, body = (m["groups"][i] for i in range(1, 4))
        bases = F.filter(_named(_flat(args)), lambda b: b.rlike(r"^[\w.]+$"))
        return _class(name, F.transform(bases, lambda b: F.substring_index(b, ".", -1)),
                      methods_of(body), m["line"])

    return F.transform(matches(content, PY_CLASS, 4), one)


def script_classes(content: Column) -> Column:
    def one(m: Column) -> Column:
        base = m["groups"][1]
        return _class(m["groups"][0], F.filter(_strings(base), lambda b: b != ""), _strings(),
                      m["line"])

    return F.transform(matches(content, JS_CLASS, 2), one)


def classes(code: DataFrame) -> DataFrame:
    """(repo_id, path, lang, name, bases, methods, start_line)."""
    code = with_heads(code, F.col("lang") == "python", "class")
    return _by_language(code, python_classes(F.col("heads")), script_classes(F.col("content")))


def code_files(files: DataFrame) -> DataFrame:
    """Files in a known code language."""
    return with_language(files)


def in_import_map(rows: DataFrame, tracked: DataFrame | None = None,
                  git_repos: DataFrame | None = None) -> DataFrame:
    """Rows whose file takes part in the import map: tracked, or outside build directories."""
    return only_tracked(rows, tracked, git_repos, outside(F.col("path"), SKIP_STRUCTURE))
