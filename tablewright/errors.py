"""What an error says of itself. Nothing here raises: a backend that is gone cannot describe its own failure."""

from __future__ import annotations

import re


def exception_name(error: BaseException) -> str:
    """The JVM class of a wrapped error, else the Python class."""
    try:
        return str(error.java_exception.getClass().getName())  # type: ignore[attr-defined]
    except Exception:
        return type(error).__name__


def exception_message(error: BaseException) -> str:
    try:
        return str(error)
    except Exception:
        return "(the error has no readable message)"


def condition(error: BaseException) -> str | None:
    """The error condition, by the error's own account or the ``[CONDITION]`` that leads its message."""
    get = getattr(error, "getCondition", None) or getattr(error, "getErrorClass", None)
    try:
        found = get() if callable(get) else None
    except Exception:
        found = None
    if found:
        return found
    match = re.match(r"\s*\[([A-Z0-9_.]+)\]", exception_message(error))
    return match[1] if match else None
