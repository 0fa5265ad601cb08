"""Errors of the engine: every one has a code, a class and an HTTP-like status."""

from __future__ import annotations


class SheetError(Exception):
    """Base of all errors. code names the case; details hold what the message is made of."""

    code = "error"
    status = 500
    exit_code = 70

    def __init__(self, message: str, code: str | None = None, **details: object):
        super().__init__(message)
        self.code = code or self.code
        self.details = details


class ConfigError(SheetError):
    """config_missing, config_invalid."""

    code, status, exit_code = "config_invalid", 500, 64


class ValidationError(SheetError):
    """validation_failed, with the issues found; filter_invalid and input_invalid for malformed requests."""

    code, status, exit_code = "validation_failed", 422, 22

    def __init__(self, message: str, code: str | None = None, issues: list | None = None, **details: object):
        super().__init__(message, code, **details)
        self.issues = issues or []


class FilterError(ValidationError):
    code = "filter_invalid"


class TransactionError(SheetError):
    """transaction_in_progress, parent_moved, write_outside_transaction, lock_held, nested_transaction, transaction_closed."""

    code, status, exit_code = "transaction_in_progress", 409, 69


class ReferenceError_(SheetError):
    """ref_not_found."""

    code, status, exit_code = "ref_not_found", 404, 66


class IndexError_(SheetError):
    """index_unique_conflict, index_not_defined."""

    code, status, exit_code = "index_unique_conflict", 409, 65


class PathError(SheetError):
    """path_render_failed, path_invalid_chars."""

    code, status, exit_code = "path_render_failed", 422, 65


class NotFoundError(SheetError):
    """record_not_found, attachment_not_found."""

    code, status, exit_code = "record_not_found", 404, 67


class ContractError(SheetError):
    """contract_missing, contract_invalid, contract_mismatch."""

    code, status, exit_code = "contract_invalid", 422, 65
