"""Manifests, versions, registry answers, health."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from codeaudit.functions.versions import base_version, version_key, version_parts, years_since
from codeaudit.operators import dependencies as D, manifests as M
from codeaudit.sources.registry import registry



def as_of():
    return F.lit(datetime.datetime(2024, 6, 1))


def declared(files_table, contents):
    rows = M.declared_dependencies(files_table(contents)).collect()
    return {(r.package, r.requested) for r in rows}


def test_requirements(files_table):
    text = ("# comment\n\nflask==2.0.1\nrequests>=2.25,<3.0\nNumPy\n-r other.txt\n-e .\n"
            "git+https://x/y\nuvicorn[standard]==0.20\npandas==1.0  # inline\n"
            'tomli>=1; python_version < "3.11"\n')
    assert declared(files_table, {"requirements.txt": text}) == {
        ("flask", "==2.0.1"), ("requests", ">=2.25,<3.0"), ("numpy", None),
        ("uvicorn", "==0.20"), ("pandas", "==1.0"), ("tomli", ">=1")}


def test_pyproject(files_table):
    text = ('[project]\nname = "x"\ndependencies = [\n  "flask>=2",\n  "uvicorn[standard]", # c\n'
            '  "tomli>=1; python_version<\'3.11\'",\n]\n[project.optional-dependencies]\n'
            'dev = ["pytest", \'ruff==1\']\n[tool.poetry.dependencies]\npython = "^3"\n'
            'Celery = {version = "^5", extras = ["redis"]}\n[tool.poetry.group.t.dependencies]\n'
            'mypy = "*"\n[tool.black]\nline-length = 100\n')
    assert declared(files_table, {"a/pyproject.toml": text}) == {
        ("flask", ">=2"), ("uvicorn", None), ("tomli", ">=1"), ("pytest", None), ("ruff", "==1"),
        ("celery", "^5"), ("mypy", "*")}
    assert declared(files_table, {"pyproject.toml": "not toml at all"}) == set()
    assert declared(files_table, {"pyproject.toml": '[project]\nname = "x"\n'}) == set()


def test_package_json(files_table):
    text = ('{"dependencies": {"express": "^4.17.1"}, "devDependencies": {"jest": "1"}, '
            '"optionalDependencies": {"o": "2"}, "peerDependencies": {"p": "3"}}')
    assert declared(files_table, {"package.json": text}) == {
        ("express", "^4.17.1"), ("jest", "1"), ("o", "2"), ("p", "3")}
    assert declared(files_table, {"package.json": "{broken"}) == set()
    assert declared(files_table, {"package.json": "{}"}) == set()


def test_other_manifests(files_table):
    assert declared(files_table, {
        "Gemfile": "gem 'rails', '~> 7.0'\n# gem 'no'\n",
        "Cargo.toml": '[package]\nname = "x"\n[dev-dependencies]\nserde = "1"\n[other]\nz = "1"\n',
        "Pipfile": '[packages]\nflask = "*"\n[requires]\npython_version = "3"\n',
    }) == {("rails", "~> 7.0"), ("serde", "1"), ("flask", "*")}


def test_scope_and_first_manifest(spark, files_table):
    files = files_table({"requirements.txt": "flask==1", "b/requirements.txt": "flask==2\nrich",
                         "node_modules/x/package.json": '{"dependencies": {"hidden": "1"}}',
                         ".cfg/requirements.txt": "hidden"})
    got = M.unique_dependencies(M.declared_dependencies(files)).collect()
    assert {(r.package, r.requested, r.manifest) for r in got} == {
        ("flask", "==1", "requirements.txt"), ("rich", None, "b/requirements.txt")}
    repos = spark.createDataFrame([("r",)], "repo_id string")
    tracked = spark.createDataFrame([("r", "b/requirements.txt")], "repo_id string, path string")
    # the root's manifest is not tracked, so all manifests of its name are skipped
    assert M.declared_dependencies(files, tracked, repos).count() == 0
    root = spark.createDataFrame([("r", "requirements.txt")], "repo_id string, path string")
    assert {r.package for r in M.declared_dependencies(files, root, repos).collect()} == {"flask"}


def test_routing(spark):
    df = spark.createDataFrame([
        ("@a/b", "requirements.txt"), ("@a/b", "package.json"), ("@a/b", "other"), ("x", "other"),
        ("x", "Gemfile"), ("x", "Cargo.toml")], "p string, b string")
    got = [r[0] for r in df.select(M.ecosystem_of(F.col("p"), F.col("b"))).collect()]
    assert got == ["pypi", "npm", "npm", "pypi", "rubygems", "crates"]


@pytest.mark.parametrize("text,parts", [("1.2.3", [1, 2, 3]), ("2.0", [2, 0]), ("3", [3]),
                                        ("1.2.3a4", [1, 2, 3]), ("", [0]), ("1-2.x", [1, 2]),
                                        ("202401011234.1", [202401011234, 1])])
def test_version_parts(spark, text, parts):
    assert spark.range(1).select(version_parts(F.lit(text))).first()[0] == parts


@pytest.mark.parametrize("spec,base", [
    ("==2.0.1", "2.0.1"), (">=2.25", "2.25"), ("^4.17.1", "4.17.1"), ("~=3.1", "3.1"),
    (">=2.25,<3.0", "2.25"), (None, None), ("*", None)])
def test_base_version(spark, spec, base):
    assert spark.range(1).select(base_version(F.lit(spec).cast("string"))).first()[0] == base


def test_years_since(spark):
    row = spark.range(1).select(years_since(F.lit("2021-06-01T00:00:00Z"), as_of()),
                                years_since(F.lit("no date"), as_of())).first()
    assert row[0] == pytest.approx(1096 / 365.25) and row[1] == 0.0


@pytest.mark.parametrize("name,eco,similar", [
    ("reqeusts", "pypi", "requests"), ("expres", "npm", "express"), ("nunpy", "pypi", "numpy"),
    ("preact", "npm", "react"), ("nuxt", "npm", "next"), ("vitest", "npm", "vite"),
    ("requests", "pypi", None), ("flask", "crates", None), ("unrelated-name", "pypi", None)])
def test_similar_popular(spark, name, eco, similar):
    got = spark.range(1).select(D.similar_popular(F.lit(name), F.lit(eco))).first()[0]
    assert got == similar


def test_registry_shapes(spark):
    raw = spark.createDataFrame([
        ("pypi", "a", 200, '{"info": {"version": "2.0.1", "summary": "s"}, "releases": {"2.0.1": ['
         '{"upload_time_iso_8601": "2021-05-11T12:00:00Z"}, {"upload_time_iso_8601": null}]}}'),
        ("npm", "b", 200, '{"dist-tags": {"latest": "4.17.21"}, "time": {"4.17.21": '
         '"2021-03-02T00:00:00Z", "modified": "x"}}'),
        ("npm", "c", 200, '{"time": {"modified": "2020-01-01T00:00:00Z"}}'),
        ("rubygems", "d", 200, '{"version": "7.1", "downloads": 12}'),
        ("crates", "e", 200, '{"crate": {"newest_version": "1.0", "updated_at": "2022-01-01", '
         '"recent_downloads": 5}}'),
        ("pypi", "f", 404, None), ("pypi", "g", 200, "no json")],
        "ecosystem string, package string, http_status int, body string")
    got = {r.package: (r.latest_version, r.latest_release_date, r.downloads)
           for r in registry(raw).collect()}
    assert got == {
        "a": ("2.0.1", "2021-05-11T12:00:00Z", None), "b": ("4.17.21", "2021-03-02T00:00:00Z", None),
        "c": (None, "2020-01-01T00:00:00Z", None), "d": ("7.1", None, 12),
        "e": ("1.0", "2022-01-01", 5), "f": (None, None, None), "g": (None, None, None)}


HEALTH = [  # found, requested, latest, released, score
    (False, None, None, None, 0), (True, None, "1.0", "2019-01-01T00:00:00Z", 0),
    (True, "==2.0.1", "2.0.1", None, 10), (True, None, "2.0.1", None, 10),
    (True, "==2.0.0", "2.0.5", None, 9), (True, "==2.0.0", "2.1.0", None, 7),
    (True, "==2.0.0", "2.2.0", None, 7), (True, "==2.0.0", "2.3.0", None, 5),
    (True, "==1.0.0", "2.0.0", None, 3), (True, "==1.0.0", "3.0.0", None, 1),
    (True, ">=1.0", None, None, 8)]
REPORTS = {
    "empty": [], "current": [2, 3], "missing": [0, 0],
    "mixed": [2, 2, 2, 2, 2, 2, 5, 6, 0, 1]}


def test_health(spark):
    deps, answers, want = [], [], {}
    for repo, cases in REPORTS.items():
        for i, k in enumerate(cases):
            found, requested, latest, released, score = HEALTH[k]
            name = f"{repo}{i}"
            deps.append((repo, name, "pypi", requested))
            if found:
                answers.append(("pypi", name, 200, latest, released))
    for k, (found, requested, latest, released, score) in enumerate(HEALTH):
        deps.append(("each", f"each{k}", "pypi", requested))
        want[f"each{k}"] = score
        answers.append(("pypi", f"each{k}", 200 if found else 404, latest, released))
    deps = spark.createDataFrame(
        deps, "repo_id string, package string, ecosystem string, requested string")
    answers = spark.createDataFrame(
        answers, "ecosystem string, package string, http_status int, latest_version string, "
                 "latest_release_date string")
    packages = D.package_health(deps, answers, as_of())
    got = {r.package: r.score for r in packages.filter("repo_id = 'each'").collect()}
    assert got == want
    repos = spark.createDataFrame([(r,) for r in REPORTS], "repo_id string")
    report = {r.repo_id: r for r in D.health_report(packages, repos).collect()}
    assert {k: r.score for k, r in report.items()} == {
        "empty": 10.0, "current": 10.0, "missing": 0.0, "mixed": 7.4}
    mixed = report["mixed"]
    assert (mixed.total_packages, mixed.up_to_date, mixed.outdated, mixed.deprecated,
            mixed.not_found) == (10, 6, 2, 1, 1)


def test_findings_of_one_join(spark):
    deps = spark.createDataFrame([
        ("r", "gone", "pypi", "requirements.txt", None),
        ("r", "reqeusts", "pypi", "requirements.txt", "==1.0"),
        ("r", "never-asked", "pypi", "requirements.txt", None),
        ("r", "serde", "crates", "Cargo.toml", "1.0")],
        "repo_id string, package string, ecosystem string, manifest string, requested string")
    answers = spark.createDataFrame([
        ("pypi", "gone", 404, None, None, None),
        ("pypi", "reqeusts", 200, "3.1", "2024-01-01T00:00:00Z", None),
        ("crates", "serde", 200, "1.0.9", "2024-01-01T00:00:00Z", 99)],
        "ecosystem string, package string, http_status int, latest_version string, "
        "latest_release_date string, downloads bigint")
    advisories = spark.createDataFrame([
        ("crates", "serde", "OSV-1", "0.9", "1.0.1", "high"),
        ("crates", "serde", "OSV-2", "1.0.1", None, "high")],
        "ecosystem string, package string, id string, introduced string, fixed string, "
        "severity string")
    got = {(r.title, r.severity) for r in D.dependency_findings(
        deps, answers, as_of(), advisories).collect()}
    assert got == {
        ("Hallucinated Package: gone", "critical"), ("Outdated Package: reqeusts", "high"),
        ("Possible Typosquat: reqeusts", "medium"),
        ("Suspicious Low-Download Package: serde", "high"), ("CVE: serde==1.0 — OSV-1", "high")}
    plan = D.dependency_findings(deps, answers, as_of())._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Join ") == 1


def sorted_keys(spark, versions, ecosystem):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(versions)], "i int, v string").select(
        "i", version_key(F.col("v"), F.lit(ecosystem)).alias("k")).collect()
    return [k for _, k in sorted(map(tuple, rows))]


@pytest.mark.parametrize("ecosystem, ascending", [
    ("pypi", ["0.9", "1.0.dev1", "1.0.dev10", "1.0a1.dev2", "1.0a1", "1.0-alpha.2", "1.0a2.post1", "1.0b1", "1.0.pre3", "1.0RC11",
              "1.0", "1.0.post1.dev3", "1.0.post1", "1.0-2", "1.0.1", "1.2.3.4", "1.2.3.5", "1.9", "1.10", "202401011234.1",
              "1" + "0" * 40, "2" + "0" * 40, "1!0.1"]),
    ("npm", ["0.9.9", "1.0.0-0", "1.0.0-9", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-alpha-x", "1.0.0-beta",
             "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0", "1." + "9" * 39 + ".0", "2.0.0"])])
def test_version_order(spark, ecosystem, ascending):
    keys = sorted_keys(spark, ascending, ecosystem)
    assert keys == sorted(set(keys))


def test_equal_and_odd_versions(spark):
    for eco, same in (("pypi", ["1", "1.0", "v1.0.0", "1.0+local", "01.0"]), ("npm", ["1.0.0", "=v1.0.0", "1.0.0+build.7", "1"]),
                      ("pypi", ["1.0rc1", "1.0.c1", "1-pre-1", "1.0preview1"])):
        assert len(set(sorted_keys(spark, same, eco))) == 1
    assert sorted_keys(spark, ["", "latest", None, "*"], "npm") == [None] * 4


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 10 ** 45), min_size=1, max_size=5), min_size=2, max_size=12))
def test_releases_compare_as_lists(spark, versions):
    keys = sorted_keys(spark, [".".join(map(str, v)) for v in versions], "npm")

    def bare(v):
        while v and v[-1] == 0:
            v = v[:-1]
        return v
    order = sorted(range(len(versions)), key=lambda i: bare(versions[i]))
    assert [keys[i] for i in order] == sorted(keys)


def test_long_numbers_and_candidates_end_nothing(spark):
    long = "1" + "0" * 45
    assert spark.range(1).select(version_parts(F.lit(f"{long}.2"))).first()[0] == [10 ** 38 - 1, 2]
    deps = spark.createDataFrame([("r", "requirements.txt", "p", "pypi", v, i) for i, v in enumerate(
        ["==1.0.0rc1", "==1.0.0", f"=={long}", ">=0.9,<2"])], "repo_id string, manifest string, package string, ecosystem string, "
        "requested string, ord int")
    advisories = spark.createDataFrame([("pypi", "p", "A", "0.9.1", "1.0.0", "high"), ("pypi", "p", "B", "5", None, "low")],
                                       "ecosystem string, package string, id string, introduced string, fixed string, severity string")
    assert sorted(r.title for r in D.known_vulnerabilities(deps, advisories).collect()) == sorted([
        "CVE: p==1.0.0rc1 — A", f"CVE: p=={long} — B"])


def test_declarations_meet_advisories_in_one_join(spark):
    """However often a package is declared: same hits as one by one, the declarations dealt once."""
    deps = spark.createDataFrame(
        [(f"r{i}", "requirements.txt", 1, "flask", "pypi", v, i) for i in range(40)
         for v in ("==1.0rc1", "==1.0", ">=2.0", None)],
        "repo_id string, manifest string, manifest_rank int, package string, ecosystem string, requested string, ord bigint")
    advisories = spark.createDataFrame(
        [("pypi", "flask", "A", "0.9", "1.0", "high"), ("pypi", "flask", "B", "1.0", None, "low"),
         ("pypi", "flask", "B", "1.0", None, "low"), ("npm", "flask", "C", None, None, "low")],
        "ecosystem string, package string, id string, introduced string, fixed string, severity string")
    found = D.known_vulnerabilities(deps, advisories)
    got = sorted((r.cwe, r.title) for r in found.filter("repo_id = 'r7'").collect())
    assert got == [("A", "CVE: flask==1.0rc1 — A")] + [("B", "CVE: flask==1.0 — B")] * 2 + [("B", "CVE: flask==2.0 — B")] * 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan


def test_reports_of_one_scanner_are_built_and_parsed_once(spark, tmp_path):
    from codeaudit.plans.corpus import Corpus
    from codeaudit.sources import reports
    spark.createDataFrame([(k, 49 + k, f"n{k}", "t", "b") for k in range(3)],
                          "p_partkey bigint, p_size int, p_name string, p_type string, p_brand string").write.parquet(
        str(tmp_path / "part.parquet"))
    made = Corpus(spark, str(tmp_path)).reports
    assert made.count() == 18 and made.filter("length(body) = 25").count() == 6
    found = reports.npm_audit(made)
    assert sorted(r.cwe or "" for r in found.collect()) == ["", "", "CVE-0", "CVE-2"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "test_name" not in plan and "check_id" not in plan and plan.count("parse_json") <= 1
