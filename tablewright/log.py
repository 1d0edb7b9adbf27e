"""Console logging for interactive runs."""

from __future__ import annotations

import logging
import sys

_COLOURS = {"DEBUG": 36, "INFO": 32, "WARNING": 33, "ERROR": 31, "CRITICAL": 35}


class _Coloured(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        text = super().format(record)
        return f"\033[{_COLOURS.get(record.levelname, 0)}m{text}\033[0m" if sys.stderr.isatty() else text


def configure_logging(level: int = logging.INFO) -> None:
    """Replace the root handlers by one on stderr; the JVM gateway only speaks of errors."""
    handler = logging.StreamHandler()
    handler.setFormatter(_Coloured("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    logging.basicConfig(level=level, handlers=[handler], force=True)
    logging.getLogger("py4j").setLevel(logging.ERROR)
