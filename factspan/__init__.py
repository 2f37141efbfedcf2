"""Spark-native processing of published statistical data."""

from factspan.operators.rules import ContractViolation, Rule, check, enforce, quarantine
from factspan.operators.history import ambiguous_revisions, contributing_releases, latest_as_of
from factspan.session import session

__all__ = [
    "ContractViolation",
    "Rule",
    "ambiguous_revisions",
    "check",
    "contributing_releases",
    "enforce",
    "latest_as_of",
    "quarantine",
    "session",
]
