"""Structured-log analytics expressed as ordinary Spark jobs."""

from tidelog.session import build_session, prepare

__all__ = ["build_session", "prepare"]
