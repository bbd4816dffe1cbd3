"""Tunables of the engine."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    """Durations are in seconds; scaled() stretches all of them for sparse data."""

    windows: tuple[int, ...] = (60, 300)
    baseline_windows: int = 30
    min_history: int = 3
    threshold: float = 4.0
    floors: tuple[tuple[str, float], ...] = (("request_count", 1.0), ("error_rate", 0.01), ("p95_latency_ms", 5.0))
    grace: int = 300
    debounce: int = 300
    alert_max: int = 600
    dedup_same: int = 300
    dedup_trace: int = 120
    dedup_span: int = 900
    proximity: int = 300
    close_gap: int = 600
    incident_max: int = 900
    min_overlap: float = 30.0
    seed: int = 42

    def scaled(self, by: int) -> Config:
        names = ("grace", "debounce", "alert_max", "dedup_same", "dedup_trace", "dedup_span", "proximity", "close_gap", "incident_max", "min_overlap")
        return replace(self, windows=tuple(w * by for w in self.windows), **{n: getattr(self, n) * by for n in names})
