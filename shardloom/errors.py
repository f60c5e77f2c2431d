"""The engine's one exception, with a stable code."""


class EngineError(Exception):
    """``code`` names the kind of failure; callers branch on it, not on the message."""

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        self.code = code
