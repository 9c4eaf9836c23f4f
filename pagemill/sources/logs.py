"""The driver's log: JSON lines in a file, plain lines on the console."""

from __future__ import annotations

import json
import logging
import os
from datetime import datetime, timezone

NAME = "pagemill"
FIXED = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}


class JsonLines(logging.Formatter):
    """timestamp, level, module, message; file and exception where given, and all extras of the record."""

    def format(self, record: logging.LogRecord) -> str:
        row = {"timestamp": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "module": record.module, "message": record.getMessage()}
        if record.exc_info:
            row["exception"] = self.formatException(record.exc_info)
        row |= {k: v for k, v in vars(record).items() if k not in FIXED}
        return json.dumps(row, ensure_ascii=False, default=str)


def set_up(path: str | None = None, level: str = "INFO") -> logging.Logger:
    """The package's logger, with one console and one file handler however often this is called."""
    log = logging.getLogger(NAME)
    log.setLevel(level)
    log.propagate = False
    for h in log.handlers[:]:
        log.removeHandler(h)
        h.close()
    console = logging.StreamHandler()
    console.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(console)
    if path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        lines = logging.FileHandler(path, encoding="utf-8")
        lines.setFormatter(JsonLines())
        log.addHandler(lines)
    return log
