"""The engine's one exception."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class EngineError(Exception):
    """A plan, a table or a file that the engine can't work with."""


@contextmanager
def engine_errors(what: str) -> Iterator[None]:
    """Turns Spark's errors inside the block into :class:`EngineError`."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        yield
    except (PySparkException, Py4JJavaError, OSError) as e:
        raise EngineError(f"{what}: {str(e).splitlines()[0] if str(e) else type(e).__name__}") from e
