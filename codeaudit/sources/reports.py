"""Reports of outside scanners as findings.

``reports(repo_id, tool, source, body)``: ``source`` is the rule file or manifest a report belongs
to. Bodies are read as VARIANT, as leaves vary in type. A malformed body yields no finding and is
counted, it never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeaudit.functions.calls import computed
from codeaudit.model import as_findings, lookup

# --- fixed values -----------------------------------------------------------
BANDIT_SEVERITY = {"LOW": "low", "MEDIUM": "medium", "HIGH": "high"}
BANDIT_CONFIDENCE = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4}
SEMGREP_SEVERITY = {"INFO": "info", "WARNING": "medium", "ERROR": "high"}
COMPLIANCE_SEVERITY = {"INFO": "low", "WARNING": "medium", "ERROR": "high"}
NPM_SEVERITY = {"critical": "critical", "high": "high", "moderate": "medium", "low": "low",
                "info": "info"}
# ----------------------------------------------------------------------------


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _or(value: Column, default: object) -> Column:
    return F.coalesce(value, F.lit(default))


def parsed(reports: DataFrame, tool: str) -> DataFrame:
    """The reports of one tool with their bodies parsed once, as ``doc``; without malformed ones."""
    return (computed(reports.filter(F.col("tool") == tool)
                     .withColumn("doc", F.try_parse_json("body")).drop("body"))
            .filter(F.col("doc").isNotNull()))


def malformed_counts(reports: DataFrame) -> DataFrame:
    """(tool, malformed, total) of all reports."""
    bad = F.try_parse_json("body").isNull() & F.col("body").isNotNull()
    return reports.groupBy("tool").agg(F.count_if(bad).alias("malformed"),
                                       F.count("*").alias("total"))


def _results(reports: DataFrame, tool: str) -> DataFrame:
    items = _get(F.col("doc"), "$.results", "array<variant>")
    return parsed(reports, tool).select("repo_id", "source",
                                        F.posexplode(items).alias("pos", "r"))


def bandit(reports: DataFrame) -> DataFrame:
    rows, r = _results(reports, "bandit"), F.col("r")
    file, line = _or(_get(r, "$.filename"), ""), _or(_get(r, "$.line_number", "int"), 0)
    text, cwe = _or(_get(r, "$.issue_text"), ""), _get(r, "$.issue_cwe.id")
    return as_findings(
        rows, analyzer="sast", category="sast", tool="bandit", ord=F.col("pos"),
        title=_or(_get(r, "$.test_name"), "Bandit Issue"),
        severity=lookup(BANDIT_SEVERITY, F.upper(_or(_get(r, "$.issue_severity"), "")), "medium"),
        file=file, line=line, description=text,
        remediation=F.concat(
            F.lit("Review the flagged code and apply the recommended secure coding pattern. See "
                  "Bandit docs for details on "), _or(_get(r, "$.test_id"), "this test"),
            F.lit(".")),
        ai_prompt=F.concat(F.lit("Review "), file, F.lit(":"), line, F.lit(" — "), text,
                           F.lit(". Suggest a secure alternative.")),
        evidence=_or(_get(r, "$.code"), ""),
        cwe=F.when(~cwe.isin("", "0"), F.concat(F.lit("CWE-"), cwe)),
        confidence=lookup(BANDIT_CONFIDENCE, F.upper(_or(_get(r, "$.issue_confidence"), "MEDIUM")),
                          0.7))


def semgrep(reports: DataFrame) -> DataFrame:
    rows, r = _results(reports, "semgrep"), F.col("r")
    file, line = _or(_get(r, "$.path"), ""), _or(_get(r, "$.start.line", "int"), 0)
    cwe = F.coalesce(_get(r, "$.extra.metadata.cwe[0]"),
                     F.when(F.schema_of_variant(F.coalesce(
                         _get(r, "$.extra.metadata.cwe", "variant"),
                         F.try_parse_json(F.lit("0")))) == "STRING",
                         _get(r, "$.extra.metadata.cwe")))
    check = _get(r, "$.check_id")
    return as_findings(
        rows, analyzer="sast", category="sast", tool="semgrep", ord=F.col("pos"),
        title=_or(check, "Semgrep Issue"), file=file, line=line,
        severity=lookup(SEMGREP_SEVERITY, F.upper(_or(_get(r, "$.extra.severity"), "")), "medium"),
        description=_or(_get(r, "$.extra.message"), "Semgrep rule matched."),
        remediation=F.concat(
            F.lit("Review the matched pattern and refactor according to secure coding "
                  "guidelines. Rule: "), _or(check, "N/A"), F.lit(".")),
        ai_prompt=F.concat(F.lit("Review "), file, F.lit(":"), line,
                           F.lit(" — Semgrep rule '"), _or(check, ""),
                           F.lit("' matched. Suggest a fix.")),
        evidence=_or(_get(r, "$.extra.lines"), ""), cwe=F.nullif(cwe, F.lit("")))


def semgrep_compliance(reports: DataFrame) -> DataFrame:
    rows, r = _results(reports, "semgrep-compliance"), F.col("r")
    line, message = _get(r, "$.start.line", "int"), _get(r, "$.extra.message")
    gdpr = F.coalesce(F.contains(F.col("source"), F.lit("gdpr")), F.lit(False))
    return as_findings(
        rows, analyzer="compliance", tool="semgrep", ord=F.col("pos"),
        category=F.when(gdpr, "compliance_gdpr").otherwise("compliance_soc2"),
        title=_or(_get(r, "$.check_id"), "compliance-issue"), file=_or(_get(r, "$.path"), ""),
        severity=lookup(COMPLIANCE_SEVERITY, _or(_get(r, "$.extra.severity"), "WARNING"),
                        "medium"),
        line=line, description=_or(message, "Compliance issue detected by semgrep"),
        remediation="Review and fix the flagged compliance issue.",
        ai_prompt=F.concat(
            F.lit("Fix the compliance issue in "), _or(_get(r, "$.path"), "this file"),
            F.lit(" at line "), _or(line.cast("string"), "?"), F.lit(": "), _or(message, "")),
        evidence=_or(_get(r, "$.extra.lines"), ""))


def semgrep_injection_hits(reports: DataFrame) -> DataFrame:
    """(repo_id, path, line_no, rule_id, message) for ``hit_segments``."""
    r = F.col("r")
    return _results(reports, "semgrep-injection").select(
        "repo_id", _or(_get(r, "$.path"), "").alias("path"),
        _or(_get(r, "$.start.line", "int"), 1).alias("line_no"),
        _or(_get(r, "$.check_id"), "prompt-injection").alias("rule_id"),
        _or(_get(r, "$.extra.message"), "Potential prompt injection surface").alias("message"))


def npm_audit(reports: DataFrame) -> DataFrame:
    """One finding per vulnerable package of ``vulnerabilities``; ``source`` is the manifest."""
    vulns = _get(F.col("doc"), "$.vulnerabilities", "map<string,variant>")
    rows = computed(parsed(reports, "npm-audit").select("repo_id", "source", F.map_entries(vulns).alias("vulns")))
    rows = rows.select("repo_id", "source", F.posexplode("vulns").alias("pos", "e"))
    rows = rows.select("repo_id", "source", "pos", F.col("e.key").alias("package"),
                       F.col("e.value").alias("v"))
    v, package = F.col("v"), F.col("package")
    rows = computed(rows.select("*", F.filter(
        F.coalesce(_get(v, "$.via", "array<variant>"), F.array().cast("array<variant>")),
        lambda x: F.schema_of_variant(x).startswith("OBJECT")).alias("via")))

    def listed(path: str) -> Column:
        return F.filter(F.transform("via", lambda x: _get(x, path)),
                        lambda s: s.isNotNull() & (s != ""))

    rows = computed(rows.select(
        "repo_id", "source", "pos", "package", "v", listed("$.title").alias("titles"),
        listed("$.url").alias("urls"), listed("$.cve").alias("cves"),
        F.lower(_or(F.nullif(_get(v, "$.severity"), F.lit("")), "moderate")).alias("severity")))
    titles, urls, cves, severity = (F.col(c) for c in ("titles", "urls", "cves", "severity"))
    name = _or(_get(v, "$.fixAvailable.name"), None)
    fix_kind = F.schema_of_variant(F.coalesce(_get(v, "$.fixAvailable", "variant"),
                                              F.try_parse_json(F.lit("false"))))
    fix = (F.when(fix_kind.startswith("OBJECT"), F.concat(
                F.lit(" Fix: update to "), F.coalesce(name, package), F.lit("@"),
                _or(_get(v, "$.fixAvailable.version"), "latest")))
            .when(_or(_get(v, "$.fixAvailable", "boolean"), False),
                  F.lit(" Run `npm audit fix` to resolve.")).otherwise(F.lit("")))
    first_two = lambda a, sep: F.array_join(F.slice(a, 1, 2), sep)
    cve_text = first_two(cves, ", ")
    return as_findings(
        rows, analyzer="dependencies", category="vulnerable_dependency", tool="npm-audit",
        ord=F.col("pos") + 100, file=F.col("source"), severity=lookup(NPM_SEVERITY, severity, "medium"),
        title=F.concat(F.lit("CVE: "), package, F.lit(" — "), F.coalesce(
            F.get(titles, 0), F.concat(F.lit("Known vulnerability in "), package))),
        description=F.concat(
            F.lit("npm audit found a "), severity, F.lit(" vulnerability in '"), package,
            F.lit("'. "), first_two(titles, " | "),
            F.when(F.size(cves) > 0, F.concat(F.lit(" ("), cve_text, F.lit(")"))).otherwise("")),
        remediation=F.concat(F.lit("Update '"), package, F.lit("' to a patched version."), fix),
        ai_prompt=F.concat(
            F.lit("Update '"), package, F.lit("' in package.json to fix "),
            F.when(F.size(cves) > 0, cve_text).otherwise("the known vulnerability"), F.lit(".")),
        evidence=F.when(F.size(urls) > 0, first_two(urls, " | ")).otherwise(
            F.concat(F.lit("npm audit --json ("), severity, F.lit(")"))),
        cwe=F.get(cves, 0))


def pip_audit(reports: DataFrame) -> DataFrame:
    """One finding per dependency and vulnerability."""
    deps = _get(F.col("doc"), "$.dependencies", "array<variant>")
    rows = parsed(reports, "pip-audit").select("repo_id", F.posexplode(deps).alias("dep_no", "d"))
    rows = rows.select(
        "repo_id", "dep_no", _or(_get(F.col("d"), "$.name"), "unknown").alias("package"),
        _or(_get(F.col("d"), "$.version"), "?").alias("version"),
        F.posexplode(_get(F.col("d"), "$.vulns", "array<variant>")).alias("pos", "v"))
    v, package = F.col("v"), F.col("package")
    vuln = _or(_get(v, "$.id"), "UNKNOWN")
    fixes = F.coalesce(_get(v, "$.fix_versions", "array<string>"), F.array().cast("array<string>"))
    has_fix, fix_text = F.size(fixes) > 0, F.array_join(fixes, ", ")
    return as_findings(
        rows, analyzer="dependencies", category="vulnerable_dependency", tool="pip-audit",
        severity="high", ord=F.col("dep_no") * 1000 + F.col("pos") + 100_000,
        file="requirements.txt",
        title=F.concat(F.lit("CVE: "), package, F.lit("=="), F.col("version"), F.lit(" — "), vuln),
        description=F.concat(
            F.lit("pip-audit found vulnerability "), vuln, F.lit(" in '"), package, F.lit("=="),
            F.col("version"), F.lit("'. "),
            F.left(_or(_get(v, "$.description"), "No description available"), F.lit(200))),
        remediation=F.when(has_fix, F.concat(
            F.lit("Update '"), package, F.lit("' to "), fix_text)).otherwise(F.concat(
                F.lit("Check for a patched version of '"), package, F.lit("'"))),
        ai_prompt=F.when(has_fix, F.concat(
            F.lit("Update '"), package, F.lit("' in requirements.txt to fix "), vuln,
            F.lit(". Safe versions: "), fix_text)).otherwise(""),
        evidence=F.concat(F.lit("https://osv.dev/vulnerability/"), vuln), cwe=vuln)
