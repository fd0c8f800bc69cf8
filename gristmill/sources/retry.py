"""Which failures pass by themselves, and calls and streams that are tried again after them.

Spark retries its own tasks; this is for what the driver opens. A failure is judged by its signs: the HTTP status it
carries, its kind, and its message. Kinds and messages are each held against one pattern, which Spark and Python both
understand, so a log line in a table and an exception at hand are judged by the same rules.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields
from typing import Any, NamedTuple, TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

T = TypeVar("T")

# HTTP statuses and message parts that mark a failure as passing, and the names of the settings.
STATUSES = (408, 429, 500, 502, 503, 504)
MARKERS = ("request time-out", "request timeout", "read timed out", "connect timeout", "connection aborted", "connection reset", "temporarily unavailable")
SETTINGS = {"again": "stream_error_retries", "first": "stream_error_retry_backoff_seconds"}

_status = "|".join(map(str, STATUSES))
#: A marker, or an HTTP error with one of the statuses before a space or after a colon.
MESSAGE = f"(?s)(?:{'|'.join(map(re.escape, MARKERS))})|^(?=.*(?:client error|server error|http))(?=.*(?:(?:{_status}) |: (?:{_status})))"
KIND = "timeout|connectionerror"


class Signs(NamedTuple):
    """What an exception, or one that led to it, tells; statuses go from the nearest to the farthest."""

    statuses: list[int]
    kinds: list[str]
    messages: list[str]

    @classmethod
    def of(cls, error: BaseException) -> Signs:
        links: dict[int, BaseException] = {}
        while error is not None and id(error) not in links:
            links[id(error)] = error
            error = error.__cause__ or error.__context__
        carriers = [x for e in links.values() for x in (getattr(e, "response", None), e)]
        codes = [getattr(x, "status_code", None) for x in carriers]
        return cls([c for c in codes if isinstance(c, int)], [type(e).__name__.lower() for e in links.values()], [str(e).lower() for e in links.values()])


def transient_message(message: Column) -> Column:
    """Whether a log line tells of a passing failure."""
    return F.lower(message).rlike(MESSAGE)


def is_transient(error: BaseException) -> bool:
    signs = Signs.of(error)
    return signs.statuses[:1] != [] and signs.statuses[0] in STATUSES or any(re.search(KIND, k) for k in signs.kinds) or any(re.search(MESSAGE, m) for m in signs.messages)


@dataclass(frozen=True)
class Patience:
    """How often something is tried again, and the seconds before the first time; each pause is twice the one before."""

    again: int = 5
    first: float = 10.0

    @classmethod
    def of(cls, settings: dict[str, Any]) -> Patience:
        """From a data set's configuration; nothing is negative."""
        return cls(**{f.name: max(0, type(f.default)(settings.get(SETTINGS[f.name], f.default))) for f in fields(cls)})

    def pauses(self) -> list[float]:
        return [self.first * (1 << i) for i in range(self.again)]


def with_retries(call: Callable[[], T], patience: Patience = Patience(), sleep: Callable[[float], None] = time.sleep) -> T:
    """call(), again after passing failures."""
    for pause in patience.pauses():
        try:
            return call()
        except Exception as e:
            if not is_transient(e):
                raise
        sleep(pause)
    return call()


def reopened(opening: Callable[[], Iterable[T]], patience: Patience = Patience(), sleep: Callable[[float], None] = time.sleep) -> Iterator[T]:
    """What a stream yields; after a passing failure it is opened anew and starts from its beginning."""
    pauses = iter(patience.pauses())
    while True:
        try:
            yield from opening()
            return
        except Exception as e:
            pause = next(pauses, None) if is_transient(e) else None
            if pause is None:
                raise
        sleep(pause)
