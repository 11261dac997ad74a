"""Failure alerts that go on to the next channel where one fails."""

from __future__ import annotations

import json
import logging
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime

from ..sources.table import Table

Channel = Callable[[dict], None]
LOG = logging.getLogger("tarnlake")


def webhook(url: str, timeout: float = 10.0) -> Channel:
    """Posts an alert as JSON; any answer but a success is a failure."""

    def send(alert: dict) -> None:
        body = json.dumps({"text": f"{alert['task']} failed: {alert['error']}", **alert}, default=str).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            if not 200 <= answer.status < 300:
                raise OSError(f"the webhook answered {answer.status}")

    return send


def to_table(table: Table) -> Channel:
    """Keeps alerts in a table."""

    def send(alert: dict) -> None:
        table.append(table.spark.createDataFrame([(alert["task"], alert["error"], alert["at"])], "task string, error string, at timestamp"))

    return send


def in_turn(*channels: Channel, now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> Callable[[str, Exception], str]:
    """A failure hook (task, error) that tries the channels in order until one takes the alert, and the log after the last. It never raises; it returns which one it was, ``log`` or a number from 0."""

    def told(task: str, error: Exception) -> str:
        alert = {"task": task, "error": f"{type(error).__name__}: {error}"[:2000], "at": now()}
        for i, send in enumerate(channels):
            try:
                send(alert)
                return str(i)
            except Exception as e:  # an alert must not hide the failure it tells of
                LOG.warning("an alert channel failed", extra={"channel": i, "reason": str(e)[:500]})
        LOG.error("%s failed", task, extra=alert)
        return "log"

    return told
