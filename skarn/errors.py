"""Errors of the library, and how Spark's become them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException, ParseException, PySparkException


class EngineError(Exception):
    """Any error of this library."""


class ConfigError(EngineError):
    pass


class SqlParseError(EngineError):
    pass


class ExecutionError(EngineError):
    pass


class StorageError(EngineError):
    pass


class ConstraintError(StorageError):
    """A change that NOT NULL, PRIMARY KEY or UNIQUE forbids; the table stays as it was."""


class TransactionError(EngineError):
    pass


@contextmanager
def translated() -> Iterator[None]:
    """Spark's errors as ours, with Spark's as the cause."""
    try:
        yield
    except ParseException as e:
        raise SqlParseError(str(e)) from e
    except AnalysisException as e:
        raise ExecutionError(str(e)) from e
    except PySparkException as e:
        raise EngineError(str(e)) from e
