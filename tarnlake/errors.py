"""Errors of the engine, each the counterpart of one stage of a query's life."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class EngineError(Exception):
    """Any failure of a query."""


class ParseError(EngineError):
    """The text is no SQL, or no query."""


class PlanError(EngineError):
    """A name, type or clause doesn't resolve."""


class ExecutionError(EngineError):
    """A task failed: overflow, division by zero, a broken file."""


class StorageError(EngineError):
    """A folder or file can't be read."""


@contextmanager
def translated() -> Iterator[None]:
    """Spark's exceptions as the engine's."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException, ParseException, PySparkException

    try:
        yield
    except EngineError:
        raise
    except ParseException as e:
        raise ParseError(str(e)) from e
    except AnalysisException as e:
        kind = StorageError if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA") else PlanError
        raise kind(str(e)) from e
    except (PySparkException, Py4JJavaError) as e:
        kind = StorageError if "FAILED_READ_FILE" in str(e) else ExecutionError
        raise kind(str(e)) from e
