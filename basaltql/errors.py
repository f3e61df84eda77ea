"""Errors of the engine."""


class EngineError(Exception):
    """A statement that cannot be run."""


class SqlSyntaxError(EngineError):
    def __init__(self, message: str, position: int | None = None):
        super().__init__(f"syntax error: {message}")
        self.position = position


class SerializationError(EngineError):
    """SQLSTATE 40001: another transaction came first."""
