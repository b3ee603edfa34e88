"""Typed errors of the log's operations."""


class LogError(Exception):
    """Any error of the log."""


class LogClosed(LogError):
    def __init__(self):
        super().__init__("queue is closed")


class NoMessages(LogError):
    def __init__(self, why: str = "no messages available"):
        super().__init__(why)


class NotFound(LogError):
    pass


class InvalidMessage(LogError, ValueError):
    pass


class Locked(LogError):
    pass
