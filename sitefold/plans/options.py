"""Settings of an export."""

from __future__ import annotations

from dataclasses import dataclass

from sitefold.functions.times import ZERO_TIME
from sitefold.operators.discovery import DEFAULT_MAX_ID
from sitefold.operators.media import DEFAULT_RETRIES

FORMATS = ("json", "markdown")


@dataclass(frozen=True)
class ExportOptions:
    """``run_time`` is the time of the export, as ``YYYY-MM-DDTHH:MM:SSZ``; it is an
    argument, so that a repeated run gives the same result. ``exact_rewrite`` also replaces
    URLs that only an earlier replacement has formed."""

    output_format: str = "json"
    run_time: str = ZERO_TIME
    discover: bool = False
    max_id: int = DEFAULT_MAX_ID
    download_media: bool = True
    retries: int = DEFAULT_RETRIES
    exact_rewrite: bool = False
    strict: bool = False

    def __post_init__(self) -> None:
        if self.output_format not in FORMATS:
            raise ValueError(f"unsupported export format: {self.output_format}")
        if self.max_id < 1:
            raise ValueError("max_id must be at least 1")
        if self.retries < 0:
            raise ValueError("retries must not be negative")

    @property
    def readme_time(self) -> str:
        return self.run_time.replace("T", " ").removesuffix("Z")
