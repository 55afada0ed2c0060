"""Completion callbacks of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class CompletionListener(StreamingQueryListener):
    """Calls ``done(query_id, error)`` once a stream ends; ``error`` is None where it ended well."""

    def __init__(self, done: Callable[[str, str | None], None]):
        self._done = done

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._done(str(event.id), event.exception)
