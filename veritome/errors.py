"""The one error type of the API: a SQLSTATE and a machine-readable detail."""

from __future__ import annotations

import json

# SQLSTATEs.
INVALID = "22023"
UNIQUE = "23505"
CHECK = "23514"
LIMIT = "54000"
PRECONDITION = "55000"
CORRUPTED = "XX001"
FORBIDDEN = "42501"
EXISTS = "42P06"
UNKNOWN_CORPUS = "42P01"
BAD_REGEX = "2201B"
CANCELLED = "57014"
BAD_JSON = "22P02"
BAD_TEXT = "22P05"


class EvidenceError(Exception):
    """``sqlstate``, ``reason`` and a ``detail`` object that repeats the reason."""

    def __init__(self, sqlstate: str, reason: str, message: str, **detail) -> None:
        super().__init__(message)
        self.sqlstate, self.reason, self.message = sqlstate, reason, message
        self.detail = {"reason": reason, **detail}

    def __str__(self) -> str:
        return f"{self.sqlstate} {self.message} {json.dumps(self.detail, ensure_ascii=False)}"


def invalid(field: str, message: str) -> EvidenceError:
    return EvidenceError(INVALID, "invalid_request", message, field=field)


def limit_exceeded(limit: str, most: int, message: str) -> EvidenceError:
    return EvidenceError(LIMIT, "limit_exceeded", message, limit=limit, max=most)


def precondition(reason: str, message: str, **detail) -> EvidenceError:
    return EvidenceError(PRECONDITION, reason, message, **detail)


def unique(reason: str, message: str, **detail) -> EvidenceError:
    return EvidenceError(UNIQUE, reason, message, **detail)


def corrupted(reason: str, message: str, **detail) -> EvidenceError:
    return EvidenceError(CORRUPTED, reason, message, **detail)


def unknown(reason: str, field: str, message: str) -> EvidenceError:
    return EvidenceError(INVALID, reason, message, field=field)


def revision_conflict(what: str, current: int, expected: int, **detail) -> EvidenceError:
    return precondition("revision_conflict", f"{what} is {current}, not {expected}", current=current, expected=expected, **detail)
