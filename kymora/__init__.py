"""Posterior-stream analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns DataFrames.  Nothing is
evaluated until the caller runs an action, except where a docstring says so.
"""

from kymora.session import local_session, shared_dir

__all__ = ["local_session", "shared_dir"]
