"""The engine's error type."""


class RasterError(ValueError):
    """An option or an input that the engine rejects; raised when the plan is made where possible."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise RasterError(message)


def positive_int(value, name: str) -> int:
    require(isinstance(value, int) and not isinstance(value, bool) and value > 0, f"{name} must be a positive integer.")
    return value


def natural(value, name: str) -> int:
    require(isinstance(value, int) and not isinstance(value, bool) and value >= 0, f"{name} must be a non-negative integer.")
    return value
