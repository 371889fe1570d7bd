"""Errors of array operations; those that depend on shapes and types are raised on the driver."""


class NDError(Exception):
    """Base of all array errors."""


class CastError(NDError, TypeError):
    """A value or type can't be converted."""


class ShapeError(NDError):
    """Shapes don't fit together."""


class DimensionError(NDError):
    """An axis or number of dimensions is out of range."""


class OperationError(NDError):
    """An operation isn't defined for its operands."""


class ValueRangeError(NDError, ValueError):
    """A parameter is out of range."""
