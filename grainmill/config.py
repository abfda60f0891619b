"""Settings of the engine's pipelines in one typed object, and parsers of their command-line values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Defaults of ingest, dedup, splits, evaluation and batch runs."""

    min_lines: int = 10
    max_lines: int = 1000
    min_stars: int = 21
    include_tests: bool = False
    permutations: int = 128
    near_threshold: float = 0.7
    shingle_tokens: int = 5
    validation_share: float = 0.1
    seed: int = 42
    sample_sizes: tuple[int, ...] = (5_000, 20_000)
    tie: float = 1e-6
    sign_floor: float = 0.005
    verdict_buffer: float = 0.01
    brittle_gap: float = 0.10
    high_recovery: float = 0.05
    prompt_tokens: int = 1024
    generation_batch: int = 32
    retries: int = 3
    call_gap_seconds: float = 30.0
    cost_success: float = 0.05
    cost_failure: float = 0.025
    languages: tuple[str, ...] = ("en", "es", "zh", "ur")
    benchmarks: tuple[str, ...] = ("inference", "choice5", "choice4", "topic")
    extra: dict[str, str] = field(default_factory=dict)


def split_list(text: str) -> list[str]:
    """Comma-separated names without blanks."""
    return [x for part in text.split(",") if (x := part.strip())]


def positive_int(text: str) -> int:
    n = int(text)
    if n <= 0:
        raise ValueError(f"{text} is not a positive number")
    return n


def non_negative(text: str) -> float:
    x = float(text)
    if not x >= 0:
        raise ValueError(f"{text} is negative")
    return x


def seed_of(text: str) -> int | None:
    """A seed's number; 'none' is no seed."""
    return None if text.strip().lower() == "none" else int(text)


def cell_flag(text: str) -> tuple[str, str]:
    """NAME=PATH."""
    name, sign, path = text.partition("=")
    if not (name.strip() and sign and path.strip()):
        raise ValueError(f"{text} is not NAME=PATH")
    return name.strip(), path.strip()
