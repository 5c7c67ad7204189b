"""Errors and their exit codes."""

from __future__ import annotations

from enum import IntEnum


class ExitCode(IntEnum):
    OK = 0
    USAGE = 1
    VALIDATION = 2
    BUDGET = 3
    DRIFT = 4
    NOT_CERTIFIED = 5
    BACKEND = 6
    SPLIT = 7


class CodingError(Exception):
    exit_code = ExitCode.USAGE

    def __init__(self, message: str, hint: str | None = None) -> None:
        super().__init__(message)
        self.hint = hint


class ProjectError(CodingError):
    exit_code = ExitCode.VALIDATION


class ValidationError(CodingError):
    exit_code = ExitCode.VALIDATION


class BudgetRefused(CodingError):
    exit_code = ExitCode.BUDGET


class DriftError(CodingError):
    exit_code = ExitCode.DRIFT


class NotCertified(CodingError):
    exit_code = ExitCode.NOT_CERTIFIED


class BackendError(CodingError):
    exit_code = ExitCode.BACKEND


class SplitViolation(CodingError):
    exit_code = ExitCode.SPLIT
