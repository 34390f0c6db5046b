"""Spark-first engine for documents, pages, code and event logs."""

from sparkloom.session import build_session

__all__ = ["build_session"]
