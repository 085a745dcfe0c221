"""Scores: golden values, properties, skewed groups."""

import random

import pytest
from pyspark.sql import functions as F

from codeaudit.model import FINDING_SCHEMA, PENALTIES, as_findings
from codeaudit.operators import review, scoring
from codeaudit.sources import sinks

# severity, category, confidence of the fifteen sample findings
SAMPLE = [
    ("critical", "secret", 1.0), ("high", "secret", 1.0),
    ("critical", "hallucinated_dependency", 1.0), ("medium", "hallucinated_dependency", 1.0),
    ("critical", "sast", 1.0), ("high", "sast", 1.0), ("medium", "sast", 1.0),
    ("high", "compliance_gdpr", 1.0), ("high", "compliance_soc2", 1.0),
    ("medium", "compliance_gdpr", 0.8),
    ("high", "prompt_injection", 1.0), ("critical", "prompt_injection", 0.95),
    ("low", "code_quality", 1.0), ("info", "llm_review", 1.0), ("info", "llm_review", 1.0),
]


def make(spark, rows, repo="r"):
    df = spark.createDataFrame(
        [(repo, i, s, c, float(p)) for i, (s, c, p) in enumerate(rows)],
        "repo_id string, i long, severity string, category string, p double")
    return as_findings(df, analyzer="sast", ord=F.col("i"), title=F.concat(F.lit("t"), F.col("i")),
                       severity=F.col("severity"), category=F.col("category"), description="d",
                       remediation="", tool="", file="a.py", line=F.col("i") + 1,
                       confidence=F.col("p"))


def expected(rows):
    """The plain definition over one group."""
    score = 100.0
    for i, (s, _, p) in enumerate(sorted(rows, key=lambda r: -PENALTIES[r[0]])):
        score -= PENALTIES[s] * p * (1 if i < 3 else 0.5 if i < 5 else 0.25)
    return max(score, 0.0)


def group_scores(df):
    return {r.grp: float(r.score) for r in scoring.group_scores(df).collect()}


def test_sample_findings(spark):
    found = make(spark, SAMPLE)
    got = group_scores(found)
    assert got == pytest.approx({
        "secrets": 55, "dependencies": 63, "sast": 48, "compliance": 64.4,
        "prompt_injection": 56.5, "code_quality": 97, "llm_review": 100})
    row = scoring.graded(scoring.composite(scoring.group_scores(found))).first()
    assert (row.score, row.grade, row.verdict) == (61.1, "D", "NEEDS REMEDIATION")


@pytest.mark.parametrize("severity,n,score", [("medium", 8, 66.75), ("high", 10, 21.25)])
def test_diminishing_penalties(spark, severity, n, score):
    assert group_scores(make(spark, [(severity, "sast", 1.0)] * n)) == {"sast": score}


def test_random_groups_equal_the_definition(spark):
    rng = random.Random(7)
    for _ in range(4):
        rows = [(rng.choice(list(PENALTIES)), "sast", rng.choice([0.4, 0.6, 0.7, 1.0]))
                for _ in range(rng.randrange(1, 60))]
        got = group_scores(make(spark, rows))["sast"]
        assert got == pytest.approx(expected(rows), abs=1e-6)
        assert 0 <= got <= 100
        worse = group_scores(make(spark, rows + [("low", "sast", 1.0)]))["sast"]
        assert worse <= got


def test_states_of_parts_merge_to_the_whole(spark):
    rows = [("high", "sast", 0.7), ("low", "sast", 1.0), ("medium", "sast", 0.4)] * 9
    whole = make(spark, rows)
    parts = [scoring.group_state(whole.filter(F.col("ord") % 3 == k)) for k in range(3)]
    merged = scoring.merge_states(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert scoring.scores_of(merged).first().score == scoring.group_scores(whole).first().score


def test_hot_group_stays_spread(spark):
    """One repository with nearly all findings: whole result, and no window over all its rows."""
    rows = [("medium", "sast", 0.5)] * 20_000
    got = scoring.group_scores(make(spark, rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan
    row = got.first()
    assert row.n_findings == 20_000 and float(row.score) == 0.0


def test_clean_and_failed_runs(spark):
    runs = spark.createDataFrame(
        [("a", "secrets", "ok"), ("a", "sast", "failed"), ("a", "compliance", "ok"),
         ("b", "llm_summarizer", "ok")], "repo_id string, analyzer string, status string")
    none = make(spark, SAMPLE[:1], "a").filter("false")
    scores = scoring.with_clean_groups(scoring.group_scores(none), scoring.scanned_runs(runs))
    assert {(r.repo_id, r.grp) for r in scores.collect()} == {
        ("a", "secrets"), ("a", "sast"), ("a", "compliance")}
    only = scoring.with_clean_groups(scoring.group_scores(none), scoring.scanned_runs(
        runs, "fast", only_ok=True))
    assert {(r.repo_id, r.grp) for r in only.collect()} == {("a", "secrets")}
    repos = runs.select("repo_id")
    assert {r.repo_id: r.score for r in scoring.composite(only, repos).collect()} == {
        "a": 100.0, "b": 100.0}


def test_gates(spark):
    found = make(spark, SAMPLE)
    repos = spark.createDataFrame([("r",), ("clean",)], "repo_id string")
    gate = {r.repo_id: (r.blocked, r.n)
            for r in scoring.severity_gate(found, repos, "high").collect()}
    assert gate == {"r": (True, 9), "clean": (False, 0)}
    with pytest.raises(ValueError):
        scoring.severity_gate(found, repos, "dreadful")
    scores = spark.createDataFrame([("r", 59.9), ("s", 60.0)], "repo_id string, score double")
    assert {r.repo_id: r.failed for r in scoring.score_gate(scores, 60).collect()} == {
        "r": True, "s": False}


def test_grades_and_verdicts(spark):
    values = [97, 96.9, 93, 90, 87, 83, 80, 79.9, 77, 73, 70, 67, 60, 59.9, 40, 39.9]
    df = spark.createDataFrame([(str(v), float(v)) for v in values],
                               "repo_id string, score double")
    got = {r.score: (r.grade, r.verdict) for r in scoring.graded(df).collect()}
    assert [got[v][0] for v in values] == [
        "A+", "A", "A", "A-", "B+", "B", "B-", "C+", "C+", "C", "C-", "D+", "D", "F", "F", "F"]
    assert got[79.9][1] == "NEEDS REMEDIATION" and got[80][1] == "PRODUCTION READY"
    assert got[59.9][1] == "NOT PRODUCTION READY" and got[39.9][1].startswith("CRITICAL")


def test_documents(spark):
    import json
    found = make(spark, SAMPLE)
    runs = spark.createDataFrame([("r", "secrets", "ok")],
                                 "repo_id string, analyzer string, status string")
    inventory = spark.createDataFrame([("r", ["Go", "Python"], 3)],
                                      "repo_id string, languages array<string>, files_scanned long")
    cards = scoring.scorecard(found, runs, inventory)
    text = lambda df: "\n".join(
        r.text for r in df.orderBy("repo_id", "section", "place").collect())
    doc = json.loads(text(sinks.json_documents(cards, found)))
    assert doc["score"] == 61.1 and doc["findings_count"] == 15 == len(doc["findings"])
    assert doc["category_scores"]["compliance"] == 64.4
    assert [f["title"] for f in doc["findings"]] == [f"t{i}" for i in range(15)]
    assert set(doc["findings"][0]) == set(sinks.FINDING_FIELDS)
    md = text(sinks.markdown_documents(cards, found)).split("\n")
    assert "**Score:** 61/100 (D) — NEEDS REMEDIATION" in md
    assert "| Sast | 48 🟩🟩🟩🟩⬜⬜⬜⬜⬜⬜ |" in md
    assert md.index("| Sast | 48 🟩🟩🟩🟩⬜⬜⬜⬜⬜⬜ |") < md.index("| Secrets | 55 🟩🟩🟩🟩🟩⬜⬜⬜⬜⬜ |")
    assert sum(x == "<details>" for x in md) == 9 and "- 🔴 **CRITICAL**: 4" in md
    back = sinks.findings_from_json(sinks.findings_json(found))
    assert back.schema.names == FINDING_SCHEMA.names
    assert sorted(map(str, back.collect())) == sorted(map(str, found.collect()))


def test_findings_at_one_place_make_a_valid_document(spark):
    import json
    found = make(spark, SAMPLE)
    found = found.unionByName(found).unionByName(found)
    runs = spark.createDataFrame([("r", "secrets", "ok"), ("empty", "secrets", "ok")],
                                 "repo_id string, analyzer string, status string")
    inventory = spark.createDataFrame([("r", ["Go"], 3)],
                                      "repo_id string, languages array<string>, files_scanned long")
    rows = sinks.json_documents(scoring.scorecard(found, runs, inventory), found).collect()
    for repo, n in (("r", 45), ("empty", 0)):
        doc = json.loads("".join(r.text for r in sorted(
            (r for r in rows if r.repo_id == repo), key=lambda r: (r.section, r.place))))
        assert len(doc["findings"]) == n == doc["findings_count"]


def test_audit_takes_excludes_scanners_and_replies(spark, files_table):
    import json
    from codeaudit.model import as_findings, finding_key
    from codeaudit.operators import known_exports
    from codeaudit.plans import audit
    from codeaudit.sources.registry import registry
    files = files_table({"src/a.py": "x = eval(y)\n", "old/b.py": "x = eval(y)\n",
                         "src/c.py": "eval(z)\n"})
    answers = registry(spark.createDataFrame(
        [], "ecosystem string, package string, http_status int, body string"))
    seen = spark.createDataFrame([("r", 3), ("r", 4)], "repo_id string, line int")

    def report(tool, rows):
        return as_findings(rows, analyzer="sast", category="sast", severity="low", title=tool, tool=tool,
                           file="src/d.py", line=F.col("line"), description="", remediation="")

    own = audit.in_scope(audit.file_findings(files), files)
    judged = own.filter("file = 'src/c.py'").select(
        finding_key().alias("key"), F.lit(json.dumps({"is_vulnerable": False})).alias("body"))
    summary = spark.createDataFrame([("r", json.dumps({"executive_summary": "fine"}))],
                                    "repo_id string, body string")
    gaps = spark.createDataFrame([("r", json.dumps([{"title": "no consent", "severity": "high"}]))],
                                 "repo_id string, body string")
    got = audit.audit_findings(
        files, known_exports.known_exports(spark), answers, F.current_timestamp(),
        excludes=["old/"], scanners=(report("semgrep", seen.filter("line = 3")), report("bandit", seen)),
        verdicts=judged, compliance_reviews=gaps, summaries=summary).collect()
    assert sorted((f.tool, f.file, f.line) for f in got if f.analyzer == "sast") == [
        ("bandit", "src/d.py", 4), ("semgrep", "src/a.py", 1), ("semgrep", "src/d.py", 3)]
    assert {f.title for f in got if f.tool.startswith("llm-")} == {"no consent", "Executive Summary"}
    assert not any(f.file == "old/b.py" for f in got)


def test_write_documents(spark, tmp_path):
    import glob
    import json
    found = make(spark, SAMPLE)
    runs = spark.createDataFrame([("r", "secrets", "ok")],
                                 "repo_id string, analyzer string, status string")
    inventory = spark.createDataFrame([("r", ["Go"], 3)],
                                      "repo_id string, languages array<string>, files_scanned long")
    out = str(tmp_path / "docs")
    sinks.write_documents(sinks.json_documents(scoring.scorecard(found, runs, inventory), found),
                          out)
    parts = sorted(glob.glob(f"{out}/repo_id=r/*.txt"))
    assert json.loads("".join(open(p).read() for p in parts))["findings_count"] == 15


def test_digest_names_the_most_severe_first(spark):
    text = review.digests(make(spark, SAMPLE)).first().digest.split("\n")
    assert text[0] == "Total: 15 findings"
    assert text[1] == "By severity: critical=4, high=5, info=2, low=1, medium=3"
    assert text[5].startswith("- [CRITICAL] t0 @ a.py:1: d") and len(text) == 20
