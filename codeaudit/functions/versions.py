"""Column helpers for version strings and release dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


MOST = "9" * 38  # what a part beyond 38 digits counts as where parts are subtracted


def _numbers(version: Column) -> Column:
    numeric = F.filter(F.split(version, r"[.\-]", -1), lambda s: s.rlike(r"^\d"))
    return F.transform(numeric, lambda s: F.coalesce(
        F.regexp_extract(s, r"^(\d+)", 1).try_cast("decimal(38,0)"), F.lit(MOST).cast("decimal(38,0)")))


def version_parts(version: Column) -> Column:
    """'1.2.3a4' -> [1,2,3]; segments without leading digits are dropped; nothing left -> [0]."""
    parts = _numbers(version)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(0).cast("decimal(38,0)")))


def padded(version: Column) -> Column:
    """The first three version parts, filled up with zeros; arrays of it compare as versions."""
    zero = F.lit(0).cast("decimal(38,0)")
    return F.slice(F.concat(_numbers(version), F.array(*[zero] * 3)), 1, 3)


def _ordered(number: Column) -> Column:
    """Digits as text that sorts by value: their number, then they. Up to 99,999 of them."""
    digits = F.ltrim(number, F.lit("0"))
    return F.concat(F.lpad(F.length(digits).cast("string"), 5, "0"), digits)


def _release(numbers: Column) -> Column:
    """The parts of a release, zeros at its end left out, each behind an r, which sorts after the end."""
    parts = F.filter(F.split(F.regexp_replace(numbers, r"(\.0+)+$", ""), r"\."), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("r"), _ordered(p))), "")


PYTHON_VERSION = (r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[._-]?(alpha|beta|preview|pre|rc|a|b|c)[._-]?(\d*))?"
                  r"(?:(?:[._-]?(post|rev|r)[._-]?(\d*))|-(\d+))?(?:[._-]?(dev)[._-]?(\d*))?")
SEMANTIC_VERSION = r"^[\sv=]*(\d+(?:\.\d+)*)(?:-([0-9A-Za-z.-]+))?"
SEMANTIC = ["npm", "crates"]


def _python_key(version: Column) -> Column:
    """PEP 440: epoch, release, pre-release, post-release, development release."""
    def group(i: int) -> Column:
        return F.regexp_extract(version, PYTHON_VERSION, i)
    pre, post, dev = F.lower(group(3)), (group(5) != "") | (group(7) != ""), group(8) != ""
    stage = F.when(pre.isin("a", "alpha"), "a").when(pre.isin("b", "beta"), "b").otherwise("c")
    return F.concat(
        _ordered(group(1)), _release(group(2)), F.lit("!"),
        F.when(pre != "", F.concat(stage, _ordered(group(4)))).when(dev & ~post, "!").otherwise("z"),
        F.when(post, F.concat(F.lit("p"), _ordered(F.concat(group(6), group(7))))).otherwise("!"),
        F.when(dev, F.concat(F.lit("d"), _ordered(group(9)))).otherwise("z"))


def _semantic_key(version: Column) -> Column:
    """Semantic versions: release, then identifiers, numbers before words, fewer before more."""
    marks = F.regexp_extract(version, SEMANTIC_VERSION, 2)
    fields = F.transform(F.split(marks, r"\."), lambda f: F.when(
        f.rlike(r"^\d+$"), F.concat(F.lit("i0"), _ordered(f))).otherwise(F.concat(F.lit("i1"), f, F.lit("!"))))
    return F.concat(_ordered(F.lit("")), _release(F.regexp_extract(version, SEMANTIC_VERSION, 1)), F.lit("!"),
                    F.when(marks == "", "z").otherwise(F.concat(F.lit("a"), F.array_join(fields, ""), F.lit(" "))))


def version_key(version: Column, ecosystem: Column) -> Column:
    """A text that sorts (bytewise) as the version does: semantic versions for npm and crates, PEP 440
    for all others; numbers of any length, pre-releases before their release. Build and local marks, and
    whatever else follows, don't count; null for what doesn't begin with a number."""
    key = F.when(ecosystem.isin(SEMANTIC), _semantic_key(version)).otherwise(_python_key(version))
    return F.when(version.rlike(r"^[\sv=]*\d"), key)


def exact_version(requested: Column) -> Column:
    """The first version in a specifier with its marks: '^1.0.0-rc.1' -> '1.0.0-rc.1'."""
    return F.nullif(F.regexp_extract(requested, r"((?:\d+!)?\d[\w.+\-]*[A-Za-z0-9]|\d)", 1), F.lit(""))


def base_version(requested: Column) -> Column:
    """The first number in a specifier: '>=2.25,<3.0' -> '2.25'; null where there is none."""
    return F.nullif(F.regexp_extract(requested, r"(\d[\d.]*)", 1), F.lit(""))


def years_since(iso_date: Column, as_of: Column) -> Column:
    """Whole days since an ISO-8601 instant over 365.25; 0 for what is no date."""
    then = F.unix_timestamp(F.try_to_timestamp(iso_date))
    days = F.floor((F.unix_timestamp(as_of) - then) / 86400)
    return F.coalesce(days / F.lit(365.25), F.lit(0.0))
