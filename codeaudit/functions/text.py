"""Column helpers over whole texts: lines, line numbers of matches, entropy, masking, JSON blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

MARK, SEPARATOR, BODY, END = "\u0001", "\u0002", "\u0003", "\u0004"


def strip(col: Column) -> Column:
    """Trim every kind of white space (Spark's trim removes blanks only)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; '' for none and for a bare dot-file."""
    return F.lower(F.regexp_extract(path, r"[^./][^/]*?(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def line_array(content: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    return F.split(F.regexp_replace(content, r"\R\z", ""), r"\R", -1)


def explode_lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line, numbered from 1. Narrow: each file explodes where it was read."""
    return (files.select(*keep, F.posexplode(line_array(F.col("content"))).alias("pos", "line"))
                 .select(*keep, (F.col("pos") + 1).alias("line_no"), "line"))


def mentions(text: Column, words: Iterable[str]) -> Column:
    """True where one of the words occurs: a plain search, far cheaper than a pattern, to keep
    patterns off the texts that cannot match."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbered_lines(content: Column) -> Column:
    """Array of (line_no, text)."""
    return F.transform(line_array(content), lambda text, i: F.struct(
        (i + 1).alias("line_no"), text.alias("text")))


def matches(content: Column, pattern: str, groups: int = 0, before: bool = False) -> Column:
    """Array of (line, match, before, groups) of a text; null where nothing matches.

    One replacement, the only search for the pattern, puts a mark and the groups in front of every
    match and an end behind it; all else is cutting at those signs, so the cost is linear. A text
    that holds one of the signs itself is searched as it is, see ``_matches_by_gaps``.
    ``line`` counts the newlines before the match. ``before`` (if asked for, else empty) is the
    text in front of the match from the last match but one on, of very long stretches the end.
    """
    heads = SEPARATOR.join(f"${g}" for g in range(1, groups + 1))
    signs = MARK + heads + BODY + "$0" + END

    def after(piece: Column) -> Column:
        return F.substring_index(piece, BODY, -1)

    def located(pieces: Column, marked: Column) -> Column:
        plain = F.regexp_replace(F.translate(marked, END, ""), MARK + "[^" + BODY + "]*" + BODY,
                                 MARK)

        def hit(piece: Column, i: Column) -> Column:
            ahead = F.lit("")
            if before:
                earlier = F.when(i > 0, F.get(pieces, i - 1)).otherwise(F.lit(""))
                ahead = F.translate(F.concat(F.right(after(earlier), F.lit(200)), F.right(
                    after(F.get(pieces, i)), F.lit(200))), END, "")
            return F.struct(
                F.substring_index(after(piece), END, 1).alias("match"), ahead.alias("before"),
                F.split(F.substring_index(piece, BODY, 1), SEPARATOR, -1).alias("groups"))

        return _with_lines(F.transform(F.slice(pieces, 2, F.size(pieces)), hit), plain)

    marked = F.regexp_replace(content, pattern, signs)
    by_signs = let(marked, lambda text: F.when(text.contains(MARK), let(
        F.split(text, MARK, -1), lambda pieces: located(pieces, text))))
    held = mentions(content, (MARK, SEPARATOR, BODY, END))
    return F.when(held, _matches_by_gaps(content, pattern, groups, before)).otherwise(by_signs)


def _with_lines(hits: Column, marked: Column) -> Column:
    """Hits with the lines on which the marks of a text stand, one mark a hit."""
    lines = F.flatten(F.transform(F.split(marked, "\n", -1), lambda s, i: F.array_repeat(
        i + 1, (F.length(s) - F.length(F.translate(s, MARK, ""))).cast("int"))))
    return F.zip_with(hits, lines, lambda h, line: F.struct(
        line.alias("line"), h["match"].alias("match"), h["before"].alias("before"),
        h["groups"].alias("groups")))


def _matches_by_gaps(content: Column, pattern: str, groups: int, before: bool) -> Column:
    """``matches`` of a text that can't be marked: matches, their groups and the gaps between them
    are searched for one by one, and only a copy that keeps nothing but newlines gets marks."""
    def newlines_of(text: Column) -> Column:
        return F.regexp_replace(text, r"[^\n]+", "")

    def located(s: Column) -> Column:
        def hit(match: Column, i: Column) -> Column:
            ahead = F.lit("")
            if before:
                front = lambda k: F.right(F.concat(F.when(k > 0, F.get(s["g0"], k - 1)).otherwise(
                    F.lit("")), F.get(s["gaps"], k)), F.lit(200))
                ahead = F.concat(F.when(i > 0, front(i - 1)).otherwise(F.lit("")), front(i))
            told = [F.get(s[f"g{g}"], i) for g in range(1, groups + 1)] or [F.lit("")]
            return F.struct(match.alias("match"), ahead.alias("before"),
                            F.array(*told).alias("groups"))

        # the gap behind the last match has no match, so it is null here and left out
        marked = F.array_join(F.zip_with(s["gaps"], s["g0"], lambda gap, match: F.concat(
            newlines_of(gap), F.lit(MARK), newlines_of(match))), "")
        return _with_lines(F.transform(s["g0"], hit), marked)

    found = F.struct(F.split(content, pattern, -1).alias("gaps"), *[
        F.regexp_extract_all(content, F.lit(pattern), F.lit(g)).alias(f"g{g}")
        for g in range(groups + 1)])
    return let(found, lambda s: F.when(F.size(s["g0"]) > 0, located(s)))


def merged(*arrays: Column) -> Column:
    """One array of all elements; null arrays count as empty."""
    return F.flatten(F.array_compact(F.array(*arrays)))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


def shannon_entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")

    def bits(total: Column, ch: Column) -> Column:
        p = (F.length(text) - F.length(F.replace(text, ch, F.lit("")))) / n
        return total - p * F.log2(p)

    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0),
                       lambda total, ch: F.when(ch == "", total).otherwise(bits(total, ch)))


def mask(secret: Column) -> Column:
    """First four characters, then stars up to the same length."""
    return F.rpad(F.left(secret, F.lit(4)), F.length(secret), "*")


def location(file: Column, line: Column, missing: str) -> Column:
    """``file:line``, else ``file``, else ``missing`` (an empty file or line 0 counts as none)."""
    has_file = F.coalesce(file, F.lit("")) != ""
    has_line = F.coalesce(line, F.lit(0)) != 0
    return (F.when(has_file & has_line, F.concat(file, F.lit(":"), line.cast("string")))
             .when(has_file, file).otherwise(F.lit(missing)))


def json_block(reply: Column, opening: str, closing: str) -> Column:
    """The JSON text of a reviewer's reply: inside a code fence if there is one, from the first
    ``opening`` to the last ``closing`` bracket; null where there is none."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?(.*?)```", 1)
    text = F.when(F.trim(fenced) != "", fenced).otherwise(reply)
    start = F.instr(text, opening)
    end = F.length(text) - F.instr(F.reverse(text), closing) + 1
    usable = (start > 0) & (F.instr(text, closing) > 0) & (end >= start)
    return F.when(usable, F.substring(text, start, end - start + 1))
