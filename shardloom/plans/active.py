"""One current engine, for callers that don't pass it on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

from shardloom.errors import EngineError
from shardloom.plans.engine import Config, Engine

_CURRENT: ContextVar[Engine | None] = ContextVar("engine", default=None)


def initialize(spark: SparkSession, config: Config, **options) -> Engine:
    """Make a new engine the current one."""
    engine = Engine(spark, config, **options)
    _CURRENT.set(engine)
    return engine


def is_initialized() -> bool:
    return _CURRENT.get() is not None


def current() -> Engine:
    if (engine := _CURRENT.get()) is None:
        raise EngineError("No engine was initialized", "NOT_INITIALIZED")
    return engine


def active_config() -> Config:
    return current().config


def reset() -> None:
    """Forget the current engine."""
    _CURRENT.set(None)


@contextmanager
def scoped(engine: Engine) -> Iterator[Engine]:
    """Within the block ``engine`` is the current one; then the one before is again."""
    token = _CURRENT.set(engine)
    try:
        yield engine
    finally:
        _CURRENT.reset(token)
