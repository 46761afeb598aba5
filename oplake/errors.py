"""Errors of the engine: one class per code, rendered as ``code: message``."""

from __future__ import annotations


class OplakeError(Exception):
    code = "aborted"

    def __init__(self, message: str = ""):
        super().__init__(message)
        self.message = message

    def __str__(self) -> str:
        return f"{self.code}: {self.message}" if self.message else self.code


class NotFound(OplakeError):
    code = "not_found"


class Corruption(OplakeError):
    code = "corruption"


class InvalidArgument(OplakeError):
    code = "invalid_argument"


class IoError(OplakeError):
    code = "io"


class NotSupported(OplakeError):
    code = "not_supported"


class Busy(OplakeError):
    code = "busy"


class Aborted(OplakeError):
    code = "aborted"


CODES = {c.code: c for c in (NotFound, Corruption, InvalidArgument, IoError, NotSupported, Busy, Aborted)}
