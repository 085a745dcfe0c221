"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from codeaudit.plans import (  # noqa: F401
    code_checks, dependency_checks, review_checks, rule_checks, score_checks, stream_checks,
)
from codeaudit.plans.common import ORACLE, QUERIES  # noqa: F401
