"""routelens: API-surface analytics as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``
for per-row expressions). ``repo_id`` is the grouping key on every table, so a
corpus of many repositories is processed by one plan.
"""

from routelens.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
