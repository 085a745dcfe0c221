"""Audit of source-repository collections as Spark DataFrame jobs."""

from codeaudit.model import FINDING_SCHEMA  # noqa: F401
