"""Versioned tables on Spark: diffs, merges, history, change logs and schema evolution."""

from rowtrail.session import local_session, tune

__all__ = ["local_session", "tune"]
