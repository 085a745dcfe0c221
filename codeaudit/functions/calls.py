"""Calls and argument lists of source texts, by a bracket automaton over tokens.

A text is read once, token by token: strings and comments are skipped whole, brackets are kept on a
stack, and a name in front of a parenthesis opens a call. So argument lists may be nested to any depth,
stand over any number of lines and hold brackets in strings. Time is linear in the text. A parenthesis
that is never closed closes nothing: its call is left out, and calls after it are found all the same.
Calls inside more than ``DEEPEST`` open brackets, which no interpreter accepts, are left out.

Both functions are Arrow functions, because running depth is beyond patterns; they take null for texts
that can't matter, which are then not sent as text.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

CALLS = T.ArrayType(T.StructType([
    T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("args", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])))]))

_NAME = r"\.?[A-Za-z_$][\w$]*+(?:\s*\.[A-Za-z_$][\w$]*+)*+"  # chains may go on in the next line
_QUOTED = r'''"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+\''''
_PY_STRING = (r'[rRbBuUfF]{0,2}(?:"""(?:[^"\\]|\\.|"(?!""))*+"""|' r"'''(?:[^'\\]|\\.|'(?!''))*+'''|" + _QUOTED + ")")
_JS_STRING = _QUOTED + r"|`(?:[^`\\]|\\.)*+`"
_TOKEN = rf"(?P<call>{_NAME}\s*\()|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<comma>,)|(?P<end>\Z)"
_HEAD = r"^[ \t]*+(?:async[ \t]++)?(?:def|class)[ \t]++\w++[ \t]*+\("
_JS_COMMENT = r"//[^\n]*+|/\*.*?\*/"
# What is no token is skipped inside the pattern: names that no parenthesis follows, numbers, letters
# beyond ASCII, dots in front of no name, quotes that open no closed string, all other signs.
_PLAIN = rf"\d[\w.]*+|\.(?![A-Za-z_$])|[^\W\dA-Za-z_]++"
_PY_SKIP = rf"""(?:(?!{_HEAD})(?:[^\w$.#"'()\[\]{{}},\n]++|\n|(?!{_PY_STRING}){_NAME}(?!\s*\()|{_PLAIN}|(?!{_PY_STRING})["']))*+"""
_JS_SKIP = rf"""(?:[^\w$./"'`()\[\]{{}},]++|{_NAME}(?!\s*\()|{_PLAIN}|(?!{_JS_COMMENT})/|(?!{_JS_STRING})["'`])*+"""
PY_TOKEN = re.compile(rf"(?ms){_PY_SKIP}(?:(?P<head>{_HEAD})|(?P<comment>#[^\n]*+)|(?P<string>{_PY_STRING})|{_TOKEN})")
JS_TOKEN = re.compile(rf"(?s){_JS_SKIP}(?:(?P<comment>{_JS_COMMENT})|(?P<string>{_JS_STRING})|{_TOKEN})")
_KEYWORD = re.compile(r"(?s)(\w+)\s*=(?!=)\s*(.*)")
DEEPEST = 200  # open brackets: Python's own tokenizer refuses programs that nest deeper
_CLOSES = {")": "(", "]": "[", "}": "{"}


def tokens(text: str, python: bool):
    """(kind, start, end) of comments, strings, calls, brackets and commas."""
    for m in (PY_TOKEN if python else JS_TOKEN).finditer(text):
        kind = m.lastgroup
        if kind != "end":
            yield kind, *m.span(kind)


def calls(text: str, python: bool, wanted: re.Pattern) -> list[tuple[int, str, list[tuple[str | None, str]]]]:
    """(start, name, [(keyword, value)]) of each closed call whose name matches ``wanted``, by start."""
    found, comments = [], []
    stack: list[tuple[str, str | None, int, list[int]]] = []  # bracket, name if wanted, start, cuts
    held = dict.fromkeys("([{", 0)  # how many of each are on the stack

    def value(a: int, b: int) -> tuple[str | None, str]:
        out, at = [], a
        for x, y in comments[bisect_right(comments, (a, a)):]:
            if x >= b:
                break
            out.append(text[at:x])
            at = y
        out = "".join((*out, text[at:b])).strip()
        named = _KEYWORD.fullmatch(out) if python else None
        return (named[1], named[2]) if named else (None, out)

    for kind, a, b in tokens(text, python):
        if kind == "comment":
            comments.append((a, b))
        elif kind == "call":
            name = re.sub(r"\s+", "", text[a:b - 1])
            stack.append(("(", name if len(stack) < DEEPEST and wanted.search(name) else None, a, [b]))
            held["("] += 1
        elif kind == "open" or kind == "head":
            stack.append((text[b - 1], None, a, [b]))
            held[text[b - 1]] += 1
        elif kind == "comma" and stack and stack[-1][1]:
            stack[-1][3].extend((a, b))
        elif kind == "close" and held[_CLOSES[text[a]]]:
            while stack[-1][0] != _CLOSES[text[a]]:
                held[stack.pop()[0]] -= 1
            bracket, name, start, cuts = stack.pop()
            held[bracket] -= 1
            if name:
                cuts.append(a)
                args = [value(x, y) for x, y in zip(cuts[::2], cuts[1::2])]
                found.append((start, name, args[:-1] if args[-1] == (None, "") else args))
    return sorted(found)


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def plain_heads(text: str) -> str:
    """The text with every argument list of a Python ``def`` or ``class`` made plain: inside it, strings,
    comments and what is nested deeper than two brackets become underscores, character by character, so
    that lines and columns stay and patterns of three levels see all of it."""
    out, at = [], 0
    depth, since, deep = 0, None, None  # in the open list, its begin, and that of what is too deep
    marks: list[tuple[int, int]] = []
    for kind, a, b in tokens(text, True):
        if kind == "head":  # also ends a list that was never closed
            depth, marks, since, deep = 1, [], b, None
            continue
        if since is None:
            continue
        if kind in ("comment", "string"):
            marks.append((a, b))
        elif kind == "call" or kind == "open":
            depth += 1
            if depth == 4:
                deep = b - 1
        elif kind == "close":
            if depth == 4 and deep is not None:
                marks.append((deep, b))
                deep = None
            depth -= 1
            if depth == 0:
                for x, y in _outer(marks):
                    out += [text[at:x], re.sub(r"[^\n]", "_", text[x:y])]
                    at = y
                since = None
    return "".join((*out, text[at:]))


def _outer(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    kept: list[tuple[int, int]] = []
    for x, y in sorted(marks, key=lambda m: (m[0], -m[1])):
        if not kept or x >= kept[-1][1]:
            kept.append((x, y))
    return kept


def calls_named(text: Column, lang: Column, wanted: str, marks: dict[str, str] | None = None) -> Column:
    """Array of (line_no, line, name, args) of the calls whose name contains a match of ``wanted``, and of
    the ``marks``, patterns of what is no call, under their names and without arguments."""
    pattern, others = re.compile(wanted), {n: re.compile(p) for n, p in (marks or {}).items()}

    def told(text: str, python: bool) -> list[dict]:
        spans = calls(text, python, pattern)
        if any(p.search(text) for p in others.values()):
            skipped = [(a, b) for k, a, b in tokens(text, python) if k in ("comment", "string")]
            for n, p in others.items():
                for m in p.finditer(text):
                    i = bisect_right(skipped, (m.start(), len(text))) - 1
                    if i < 0 or skipped[i][1] <= m.start():
                        spans.append((m.start(), n, []))
        if not spans:
            return []
        starts, out = line_starts(text), []
        for a, name, args in sorted(spans, key=lambda s: s[0]):
            i = bisect_right(starts, a)
            end = starts[i] - 1 if i < len(starts) else len(text)
            out.append({"line_no": i, "line": text[starts[i - 1]:end].removesuffix("\r"), "name": name,
                        "args": [{"key": k, "value": v} for k, v in args]})
        return out

    @F.arrow_udf(CALLS)
    def found(text: pa.Array, lang: pa.Array) -> pa.Array:
        arg = pa.struct([("key", pa.string()), ("value", pa.string())])
        call = pa.struct([("line_no", pa.int32()), ("line", pa.string()), ("name", pa.string()), ("args", pa.list_(arg))])
        return pa.array([None if t is None else told(t, x == "python") for t, x in zip(text.to_pylist(), lang.to_pylist())],
                        pa.list_(call))
    return found(text, lang)


def with_plain_heads(text: Column) -> Column:
    """``plain_heads`` of each text."""
    @F.arrow_udf(T.StringType())
    def plain(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else plain_heads(t) for t in text.to_pylist()], pa.string())
    return plain(text)


def computed(rows: DataFrame) -> DataFrame:
    """``rows`` with their columns computed here, once, for any number of expressions behind."""
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))


def with_heads(files: DataFrame, python: Column, *words: str) -> DataFrame:
    """``files`` with ``heads``: the text with plain argument lists where it is Python and holds one of
    ``words``, else as it is."""
    content, held = F.col("content"), F.lit(False)
    for w in words:
        held = held | content.contains(w)
    told = computed(files.select("*", with_plain_heads(F.when(python & held, content)).alias("heads")))
    return told.withColumn("heads", F.coalesce("heads", "content"))
