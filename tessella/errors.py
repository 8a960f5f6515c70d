"""Errors that the engine raises; each is reported to the caller, none is swallowed."""


class EngineError(Exception):
    """Base of all errors of the engine."""


class SyntaxProblem(EngineError):
    """The statement is not in the dialect."""


class ConstraintViolation(EngineError):
    """A primary key, UNIQUE or foreign key constraint would be broken."""


class TransactionConflict(EngineError):
    """Another transaction committed first."""


class AccessDenied(EngineError):
    """The session's user lacks the privilege."""


class NotFound(EngineError):
    """No such table, column, index, savepoint or user."""
