"""Spark engine that turns tables of stored web pages into book tables."""

from pageloom.config import JobConfig
from pageloom.session import prepare_session

__all__ = ["JobConfig", "prepare_session"]
