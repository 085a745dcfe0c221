"""The whole audit as a few passes over the files table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codeaudit.model import emit, union_findings
from codeaudit.operators import cost, frontend, known_exports, manifests, review, rules, secrets
from codeaudit.operators.dependencies import dependency_findings
from codeaudit.sources.files import SKIP_COST, SKIP_HTML, exclude_paths, outside, with_language

FAMILIES = ("sast", "gdpr", "soc2", "injection")


def file_findings(files: DataFrame) -> DataFrame:
    """Every check that needs one file only, in one pass: secrets, rules, Next.js, cost."""
    checks = [*secrets.secret_checks(), *[rules.rule_check(f) for f in FAMILIES],
              *frontend.next_checks(), *cost.cost_checks()]
    return emit(rules.with_calls(with_language(files, keep_others=True)), checks)


def in_scope(findings: DataFrame, files: DataFrame, tracked: DataFrame | None = None,
             git_repos: DataFrame | None = None) -> DataFrame:
    """Findings of each analyzer's scope, by flags joined to the narrow findings rows."""
    rows = findings.join(frontend.next_repos(files).withColumn("is_next", F.lit(True)),
                         "repo_id", "left")
    allowed: Column = F.lit(None).cast("boolean")  # null: not a git repository
    if tracked is not None and git_repos is not None:
        names = tracked.select("repo_id", F.col("path").alias("file"),
                               F.lit(True).alias("is_tracked")).distinct()
        repos = git_repos.select("repo_id", F.lit(True).alias("is_git")).distinct()
        rows = rows.join(repos, "repo_id", "left").join(names, ["repo_id", "file"], "left")
        allowed = F.when(F.col("is_git"), F.coalesce("is_tracked", F.lit(False)))
    vendored = F.lit(False)
    for name in SKIP_HTML:
        vendored = vendored | F.col("file").contains(name)
    keep = (F.when(F.col("analyzer") == "nextjs", F.coalesce("is_next", F.lit(False)) & F.coalesce(
                allowed, ~(vendored & (F.col("ord") == 4))))
             .when(F.col("analyzer") == "cost_efficiency", F.coalesce(
                 allowed, outside(F.col("file"), SKIP_COST)))
             .otherwise(True))
    return rows.filter(keep).select(*findings.columns)


def audit_findings(files: DataFrame, exports: DataFrame, registry: DataFrame, as_of: Column,
                   advisories: DataFrame | None = None, tracked: DataFrame | None = None,
                   git_repos: DataFrame | None = None,
                   reported: DataFrame | None = None, excludes: Sequence[str] = (),
                   scanners: tuple[DataFrame, DataFrame] | None = None,
                   verdicts: DataFrame | None = None, compliance_reviews: DataFrame | None = None,
                   summaries: DataFrame | None = None) -> DataFrame:
    """All analyzers' findings. Three passes over file contents: the checks of single files,
    imports, and manifests, of which a scan prunes all other files. Store the result before
    several steps read it.

    ``excludes`` are configured directories and files that no analyzer sees. ``scanners`` are the
    ingested findings of two code scanners, the preferred one first, of which one stays per place;
    ``reported`` adds any others as they are. ``verdicts`` are replies to single findings,
    ``compliance_reviews`` and ``summaries`` replies about repositories, see ``review``.
    """
    files = exclude_paths(files, excludes)
    deps = manifests.unique_dependencies(
        manifests.declared_dependencies(files, tracked, git_repos))
    own = in_scope(file_findings(files), files, tracked, git_repos)
    parts = [
        own if verdicts is None else review.apply_verdicts(own, verdicts),
        known_exports.hallucinated_imports(files, exports, tracked, git_repos),
        dependency_findings(deps, registry, as_of, advisories),
    ]
    if scanners is not None:
        parts.append(rules.merge_scanners(*scanners))
    if compliance_reviews is not None:
        parts.append(review.compliance_replies(compliance_reviews))
    if summaries is not None:
        parts.append(review.summary_replies(summaries))
    if reported is not None:
        parts.append(reported)
    return union_findings(*parts)
