"""Run-time options, checked once when they are built."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

EVENT_TIME_MODES = ("publish", "payload")


@dataclass(frozen=True)
class PipelineConfig:
    """Options shared by the batch and the streaming jobs.

    ``event_time`` chooses the clock that windows use: ``publish`` is the time the
    broker took the message, ``payload`` is the ``timestamp`` inside the message.
    """

    # The defaults of windows, threshold, fallback and short recordings.
    window_seconds: int = 30
    slide_seconds: int = 5
    toxic_threshold: float = 0.60
    fallback_score: float = 0.00001
    event_time: str = "publish"
    # How far messages may come out of order before a stream drops them.
    watermark_delay: str = "60 seconds"
    # A payload's clock may run ahead of the broker's by this; beyond it, it is taken as wrong.
    clock_tolerance_seconds: int = 600
    # A source that has sent nothing for this long does not hold the others' clock back.
    idle_seconds: int = 300
    # So long behind the watermark, alerts are still corrected for late rows; -1 for ever.
    correct_seconds: int = 3600
    strict_key_filter: bool = True
    translate: bool = False
    short_audio_seconds: float = 60.0
    # Windows of one user are ordered in slices of this many slides, so that one
    # very active user is spread over tasks. See operators.ordering.
    slides_per_slice: int = 65536

    def __post_init__(self) -> None:
        if self.slide_seconds <= 0 or self.window_seconds <= 0:
            raise ValueError("window and slide must be positive")
        if self.slide_seconds > self.window_seconds:
            raise ValueError("the slide must not be longer than the window")
        if not 0.0 <= self.toxic_threshold <= 1.0:
            raise ValueError("the toxic threshold lies between 0 and 1")
        if self.event_time not in EVENT_TIME_MODES:
            raise ValueError(f"event_time must be one of {EVENT_TIME_MODES}")
        if self.slides_per_slice <= 0:
            raise ValueError("slides_per_slice must be positive")

    @classmethod
    def from_strings(cls, options: Mapping[str, str]) -> PipelineConfig:
        """Options as they come from a command line or a settings file."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        unknown = sorted(set(options) - set(kinds))
        if unknown:
            raise ValueError(f"unknown options {unknown}")
        truth = {"true": True, "false": False}
        return cls(
            **{
                name: truth[text.lower()] if kinds[name] is bool else kinds[name](text)
                for name, text in options.items()
            }
        )

    @property
    def delay_seconds(self) -> float:
        """``watermark_delay`` as a number: one or more pairs of a number and a unit."""
        sizes = {"millisecond": 0.001, "second": 1, "minute": 60, "hour": 3600, "day": 86400}
        parts = self.watermark_delay.split()
        try:
            return sum(float(n) * sizes[unit.lower().rstrip("s")] for n, unit in zip(parts[::2], parts[1::2], strict=True))
        except (KeyError, ValueError):
            raise ValueError(f"no delay: {self.watermark_delay!r}") from None

    @property
    def panes_per_window(self) -> int:
        """How many slides make one window; only whole numbers can use panes."""
        if self.window_seconds % self.slide_seconds:
            raise ValueError("panes need a window that is a multiple of the slide")
        return self.window_seconds // self.slide_seconds

    @property
    def slice_seconds(self) -> int:
        return self.slide_seconds * self.slides_per_slice
