"""Compliance profile of a repository: routes, protection, personal data, logging, controls.

``file_facts`` reads each file once and keeps a narrow row of what it found; everything else works
on those rows. Lists in a profile are short by definition (top of an order), counts are aggregates.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeaudit.functions.text import matches, mentions, merged
from codeaudit.functions.calls import with_heads
from codeaudit.operators.structure import PY_FROM, PY_FUNCTION
from codeaudit.sources.files import SKIP_PROFILE, only_tracked, outside

# --- fixed values -----------------------------------------------------------
VERBS = ["get", "post", "put", "delete", "patch"]
AUTH_MARKS = r"login_required|auth|Depends|jwt_required|permission"
PII_PYTHON = (r"(?i)(email|password|passwd|phone|ssn|social_security|credit_card|card_number|"
              r"address|date_of_birth|dob|first_name|last_name|full_name|ip_address)")
PII_SCRIPT = r"(?i)(email|password|phone|ssn|creditCard|cardNumber|address|dateOfBirth)"
PII_ANCHORS = ["email", "passw", "phone", "ssn", "social_sec", "card", "address", "birth", "dob",
               "_name"]
SCRIPT_ROUTE = r"(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['\"]([^\n]*?)['\"]"
EXPORTED_FUNCTION = r"export\s+(?:default\s+)?(?:async\s+)?function\s+\w+"
GUARD_WORDS = r"(?i)auth|middleware|protect|guard|session"
GUARD_VERBS = r"(?i)require|check|verify|validate"
LOG_CALL = r"(?m)\.(?:info|warning|error|debug|critical|log)\s*\(|(?:^|[^\w.])print\s*\("
LIST_FRAMEWORKS, LIST_ROUTES, LIST_PII_FILES, LIST_PII_WORDS, LIST_AUTH = 5, 8, 8, 5, 5
# ----------------------------------------------------------------------------

DECORATOR = r"@([^\n]*)"
ASSIGNMENT = r"(?m)^[ \t]*((?:[A-Za-z_][\w.]*[ \t]*=(?!=)[ \t]*)+)(?![^\n]*,[ \t]*$)"
BLOCK = 50000  # routes or names of a group


def _python_routes(content: Column, path: Column) -> Column:
    """Array of (method, route_path, route) over the decorators of plain functions."""
    def route(d: Column) -> Column:
        method = F.lit("?")
        for verb in reversed(VERBS):
            method = F.when(F.lower(d).contains(verb), verb.upper()).otherwise(method)
        where = F.regexp_extract(d, r"^[\w.]+\(\s*[rbf]?['\"]([^'\"]*)['\"]", 1)
        return _route(method, F.when(where != "", where).otherwise("?"), path)

    def routes(m: Column) -> Column:
        return F.transform(F.filter(_decorators(m), lambda d: d.rlike(
            "route|get|post|put|delete|patch")), route)

    plain = F.filter(matches(content, PY_FUNCTION, 6), lambda m: m["groups"][2] == "")
    return F.flatten(F.transform(plain, routes))


def _decorators(m: Column) -> Column:
    return F.regexp_extract_all(m["groups"][1], F.lit(DECORATOR), F.lit(1))


def _route(method: Column, route_path: Column, file: Column) -> Column:
    text = F.concat(method, F.lit(" "), route_path, F.lit(" ("), file, F.lit(")"))
    return F.struct(method.alias("method"), route_path.alias("route_path"), text.alias("route"))


def _script_routes(content: Column, path: Column) -> Column:
    called = F.transform(matches(content, SCRIPT_ROUTE, 2), lambda m: _route(
        F.upper(m["groups"][0]), m["groups"][1], path))
    by_file = F.struct(F.lit("API_ROUTE").alias("method"), path.alias("route_path"),
                       F.concat(F.lit("API_ROUTE "), path).alias("route"))
    in_api = path.contains("pages/api/") | path.contains("app/api/")
    return merged(called, F.when(in_api & content.rlike(EXPORTED_FUNCTION), F.array(by_file)))


def _python_auth(content: Column) -> Column:
    def named(m: Column) -> Column:
        return F.transform(F.filter(_decorators(m), lambda d: d.rlike(AUTH_MARKS)),
                           lambda d: m["groups"][3])

    plain = F.filter(matches(content, PY_FUNCTION, 6), lambda m: m["groups"][2] == "")
    return F.flatten(F.transform(plain, named))


def _python_fields(content: Column) -> Column:
    targets = F.flatten(F.transform(matches(content, ASSIGNMENT, 1), lambda m: F.transform(
        F.split(m["groups"][0], r"\s*=\s*"), lambda t: F.substring_index(t, ".", -1))))
    return F.when(mentions(F.lower(content), PII_ANCHORS),
                  F.filter(targets, lambda t: t.rlike(PII_PYTHON)))


def _python_frameworks(content: Column) -> Column:
    def framework(m: Column) -> Column:
        module = m["groups"][0]
        return (F.when(module.contains("flask"), "Flask").when(module.contains("fastapi"), "FastAPI")
                .when(module.contains("django"), "Django"))

    return F.array_compact(F.transform(matches(content, PY_FROM, 3), framework))


def file_facts(files: DataFrame, tracked: DataFrame | None = None,
               git_repos: DataFrame | None = None) -> DataFrame:
    """One narrow row per Python or script file in scope."""
    content, path, ext = F.col("content"), F.col("path"), F.col("ext")
    py = ext == ".py"
    rows = with_heads(files.filter(ext.isin(".py", ".js", ".ts", ".jsx", ".tsx")), py, "def")
    heads = F.col("heads")
    lower = F.lower(content)
    words = lambda p: F.when(mentions(lower, PII_ANCHORS), F.regexp_extract_all(
        content, F.lit(p), F.lit(1))).otherwise(F.array().cast("array<string>"))
    guarded = content.rlike(GUARD_WORDS) & content.rlike(GUARD_VERBS)
    logs = content.contains("console.log") | content.contains("console.error")
    strings = lambda *c: F.array(*c).cast("array<string>")
    script_frameworks = F.array_compact(F.array(
        F.when(content.contains("express"), "Express"),
        F.when(F.lower(path).contains("next") | content.contains("Next"), "Next.js")))
    has = lambda *w: mentions(lower, w)
    pick = lambda python, script: F.when(py, python).otherwise(script)
    facts = rows.select(
        "repo_id", "path",
        pick(_python_routes(heads, path), _script_routes(content, path)).alias("routes"),
        pick(_python_auth(heads), F.when(guarded, strings(F.lit("middleware")))).alias("auth"),
        pick(words(PII_PYTHON), words(PII_SCRIPT)).alias("words"),
        pick(_python_fields(content), words(PII_SCRIPT)).alias("pii_fields"),
        pick(F.regexp_count(content, F.lit(LOG_CALL)), logs.cast("int")).alias("log_calls"),
        F.array_distinct(pick(_python_frameworks(content), script_frameworks))
         .alias("frameworks"),
        has("consent", "gdpr").alias("consent"),
        (has("delete") & has("user", "account")).alias("deletion"),
        (py & has("encrypt", "fernet", "aes")).alias("encryption"),
        (py & has("bcrypt", "argon2", "pbkdf2")).alias("hashing"))
    facts = facts.withColumn("words", F.array_sort(F.array_distinct("words")))
    return only_tracked(facts, tracked, git_repos, outside(path, SKIP_PROFILE))


def routes(facts: DataFrame) -> DataFrame:
    """(repo_id, path, pos, method, route_path, route)."""
    return facts.select("repo_id", "path", F.posexplode("routes").alias("pos", "r")).select(
        "repo_id", "path", "pos", "r.*")


def auth_functions(facts: DataFrame) -> DataFrame:
    """(repo_id, path, name, auth) per marked function or guarded script."""
    rows = facts.select("repo_id", "path", F.explode("auth").alias("name"))
    return rows.withColumn("auth", F.concat("name", F.lit(" ("), "path", F.lit(")")))


def with_protection(route_rows: DataFrame, auth_rows: DataFrame) -> DataFrame:
    """Routes with ``protected``: some auth name of the repository occurs in the route's text.

    An automaton of a repository's names reads each of its routes once and stops at the first
    name. Routes and names are dealt into blocks of about ``BLOCK`` rows by hash, so that a
    repository of any size is many small groups; one with a single block of names, which is the
    rule, has each route read once.
    """
    key = ["repo_id", "path", "pos"]
    names = auth_rows.filter("name != ''").select("repo_id", "name").distinct()

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("repo_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    sizes = blocks(route_rows, "n_routes").join(blocks(names, "n_names"), "repo_id")

    def dealt(rows: DataFrame, own: str, other: str, told: list[str]) -> DataFrame:
        block = F.pmod(F.xxhash64(*told), F.col(f"n_{own}"))
        copies = F.sequence(F.lit(0), F.col(f"n_{other}") - 1)
        return rows.join(sizes, "repo_id").select(
            *[F.col(c).alias(c) for c in rows.columns],  # both sides may come from one table
            block.cast("int").alias(own), F.explode(copies).alias(other))

    by = ["repo_id", "routes", "names"]
    hit = (dealt(route_rows.select(*key, "route"), "routes", "names", [*key, "route"]).groupBy(*by)
           .cogroup(dealt(names, "names", "routes", ["name"]).groupBy(*by))
           .applyInArrow(_guarded, route_rows.select(*key).schema)
           .distinct().withColumn("protected", F.lit(True)))
    return route_rows.join(hit, key, "left").withColumn(
        "protected", F.coalesce("protected", F.lit(False)))


def _guarded(routes: pa.Table, names: pa.Table) -> pa.Table:
    """Keys of the routes in whose text one of the names occurs."""
    automaton = ahocorasick.Automaton()
    for name in names["name"].to_pylist():
        automaton.add_word(name, True)
    automaton.make_automaton()
    found = [bool(len(automaton)) and next(automaton.iter(text or ""), None) is not None
             for text in routes["route"].to_pylist()]
    return routes.select(["repo_id", "path", "pos"]).filter(pa.array(found, pa.bool_()))


def _top(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows per key; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)


def _list(rows: DataFrame, key: str, order: list[str], n: int, text: Column | str,
          name: str) -> DataFrame:
    """(key, name): the texts of the first n rows per key, joined by commas."""
    top = _top(rows, [key], order, n).withColumn("_text", F.col(text) if isinstance(text, str)
                                                 else text)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_text"))),
                        lambda x: x["_text"])
    return top.groupBy(key).agg(F.array_join(texts, ", ").alias(name))


def pii_files(facts: DataFrame) -> DataFrame:
    """(repo_id, path, words): the first files by path with their first words in order."""
    rows = facts.filter(F.size("words") > 0).select("repo_id", "path", "words")
    return _top(rows, ["repo_id"], ["path"], LIST_PII_FILES).select(
        "repo_id", "path", F.slice("words", 1, LIST_PII_WORDS).alias("words"))


def pii_fields(facts: DataFrame) -> DataFrame:
    return facts.select("repo_id", "path", F.explode("pii_fields").alias("name"))


def controls(facts: DataFrame) -> DataFrame:
    """Per repository: logging calls and files, files with personal data, control flags,
    frameworks (five at most exist)."""
    return facts.groupBy("repo_id").agg(
        F.sum("log_calls").cast("bigint").alias("log_calls"),
        F.count_if(F.col("log_calls") > 0).alias("log_files"),
        F.count_if(F.size("words") > 0).alias("pii_files"),
        *[F.bool_or(c).alias(c) for c in ("consent", "deletion", "encryption", "hashing")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("frameworks")))).alias("frameworks"))


def profiles(facts: DataFrame) -> DataFrame:
    """(repo_id, profile): the structural summary that a compliance review reads. Takes several
    passes over ``facts``, so hand in a stored table."""
    found = with_protection(routes(facts), auth_functions(facts))
    counts = found.groupBy("repo_id").agg(F.count_if("protected").alias("n_protected"),
                                          F.count_if(~F.col("protected")).alias("n_open"))
    order = ["path", "pos"]
    closed = _list(found.filter("protected"), "repo_id", order, LIST_ROUTES, "route", "protected")
    opened = _list(found.filter("NOT protected"), "repo_id", order, LIST_ROUTES, "route", "open")
    auth = _list(auth_functions(facts).select("repo_id", "auth").distinct(), "repo_id", ["auth"],
                 LIST_AUTH, "auth", "auth")
    pii = pii_files(facts).groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat(F.lit("  - "), F.col("path"), F.lit(": "), F.array_join("words", ", ")))),
        "\n").alias("pii"))
    rows = controls(facts)
    for part in (counts, closed, opened, auth, pii):
        rows = rows.join(part, "repo_id", "left")
    yes = lambda c: F.when(F.col(c), "YES").otherwise("NOT DETECTED")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    text = F.concat_ws(
        "\n",
        F.when(F.size("frameworks") > 0, F.concat(F.lit("Frameworks: "), F.array_join(
            F.slice("frameworks", 1, LIST_FRAMEWORKS), ", "))),
        F.when(F.col("protected").isNotNull(), F.concat(
            F.lit("Protected routes ("), n("n_protected"), F.lit("): "), "protected")),
        F.when(F.col("open").isNotNull(), F.concat(
            F.lit("Unprotected routes ("), n("n_open"), F.lit("): "), "open")),
        F.when(F.col("n_open").isNull(), F.lit("Routes: NONE DETECTED")),
        F.when(F.col("pii").isNotNull(), F.concat(
            F.lit("PII-like fields found in "), n("pii_files"), F.lit(" files:\n"), "pii"))
         .otherwise("PII-like fields: NONE DETECTED"),
        F.when(F.col("auth").isNotNull(), F.concat(F.lit("Auth decorators: "), "auth"))
         .otherwise("Auth decorators: NONE DETECTED"),
        F.when(F.col("log_calls") > 0, F.concat(
            F.lit("Logging: "), n("log_calls"), F.lit(" calls across "), n("log_files"),
            F.lit(" files"))).otherwise("Logging: NONE DETECTED"),
        F.concat(F.lit("Consent mechanism: "), yes("consent")),
        F.concat(F.lit("Deletion endpoint: "), yes("deletion")),
        F.concat(F.lit("Encryption at rest: "), yes("encryption")),
        F.concat(F.lit("Password hashing (bcrypt/argon2): "), yes("hashing")))
    return rows.select("repo_id", text.alias("profile"))
