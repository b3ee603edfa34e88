"""Options of a log, checked when made. Times are nanoseconds, sizes bytes; 0 turns a limit off unless said otherwise."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field

from .observe import Logger, Metrics

SECOND = 1_000_000_000
MB = 1 << 20


@dataclass(frozen=True)
class Retention:
    max_age: int = 0
    max_segments: int = 0
    max_size: int = 0
    min_segments: int = 1

    def __post_init__(self):
        if min(self.max_age, self.max_segments, self.max_size, self.min_segments) < 0:
            raise ValueError("retention limits must not be negative")


@dataclass(frozen=True)
class Rotation:
    """by: size, count, both or time."""

    by: str = "both"
    max_bytes: int = 100 * MB
    max_messages: int = 1_000_000
    max_time: int = 0

    def __post_init__(self):
        if self.by not in ("size", "count", "both", "time"):
            raise ValueError(f"unknown rotation {self.by!r}")
        if self.max_messages <= 0 or self.max_bytes <= 0 or self.max_time < 0:
            raise ValueError("rotation limits must be positive")


@dataclass(frozen=True)
class Options:
    rotation: Rotation = field(default_factory=Rotation)
    #: None keeps everything.
    retention: Retention | None = None
    protect_unread: bool = False
    priorities: bool = False
    starvation: int = 30 * SECOND
    dlq_path: str = ""
    max_retries: int = 3
    dlq_max_age: int = 0
    dlq_max_size: int = 0
    max_message_bytes: int = 10 * MB
    min_free_bytes: int = 100 * MB
    compression: int = 0
    compression_level: int = 0
    compression_min_bytes: int = 1024
    dedup_window: int = 0
    dedup_max_entries: int = 100_000
    metrics: Metrics = field(default_factory=Metrics, compare=False)
    logger: Logger = field(default_factory=Logger, compare=False)

    def __post_init__(self):
        sizes = (self.max_message_bytes, self.min_free_bytes, self.dlq_max_age, self.dlq_max_size, self.compression_min_bytes, self.dedup_window, self.starvation)
        if min(sizes) < 0:
            raise ValueError("sizes and times must not be negative")
        if self.max_retries < 0:
            raise ValueError("max retries must not be negative")
        if self.compression not in (0, 1):
            raise ValueError("compression must be 0 (none) or 1 (gzip)")
        if not -2 <= self.compression_level <= 9:
            raise ValueError("compression level must be in [-2, 9]")
        if self.dlq_path:
            check_path(self.dlq_path)


def check_path(path: str) -> str:
    """A clean path, or one with a scheme; ``..`` is refused."""
    bare = path.split("://", 1)[-1]
    if not bare or ".." in bare.split("/") or posixpath.normpath(bare) != bare.rstrip("/"):
        raise ValueError(f"path is empty or not clean: {path!r}")
    return path.rstrip("/")


def check_disjoint(log: str, dlq: str) -> None:
    a, b = check_path(log) + "/", check_path(dlq) + "/"
    if a.startswith(b) or b.startswith(a):
        raise ValueError("the log and its dead-letter log must not share a path")
