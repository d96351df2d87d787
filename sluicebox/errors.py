"""Errors of the record engine."""


class SluiceError(Exception):
    """Base of all errors here."""


class UnmatchedColumns(SluiceError):
    """A result has columns that the record schema doesn't know."""

    def __init__(self, columns):
        super().__init__(f"no field for columns: {', '.join(columns)}")
        self.columns = list(columns)


class MissingIdentity(SluiceError):
    """An update or delete of a record type without identity columns."""


class DuplicateKey(SluiceError):
    """Two records, or a record and a row, share a key."""


class ConstraintViolation(SluiceError):
    """Records break a declared constraint; ``violations`` is a DataFrame."""

    def __init__(self, message, violations=None):
        super().__init__(message)
        self.violations = violations


class UnsupportedKind(SluiceError):
    """A dictionary kind that the product has no query for."""
