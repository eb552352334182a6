"""Job parameters. Every default can be replaced per run; nothing here is read from the environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScanConfig:
    max_line_length: int | None = None  # None keeps lines whole
    truncation_suffix: str = "...[truncated]"


@dataclass(frozen=True)
class Thresholds:
    """Warning / critical limits for resource gauges (percent, or multiples of the core count for load)."""

    cpu: tuple[float, float] = (80.0, 95.0)
    memory: tuple[float, float] = (85.0, 95.0)
    disk: tuple[float, float] = (85.0, 95.0)
    inodes: tuple[float, float] = (85.0, 95.0)
    load_per_core: tuple[float, float] = (2.0, 4.0)
    check_inodes: bool = False


@dataclass(frozen=True)
class DeclaredLimits:
    """Plain limits on single samples, statements and alert rates."""

    db_connections: int = 100
    query_s: int = 30
    alerts_per_hour: int = 100


@dataclass(frozen=True)
class CorrelationConfig:
    """Sliding correlation window. ``window_s`` must be a multiple of ``slide_s``."""

    window_s: int = 300
    slide_s: int = 30
    ip_min_events: int = 5
    auth_min: int = 5
    web_min: int = 20
    security_min: int = 5
    account_min_events: int = 3
    account_category_min: int = 2
    account_active_categories: int = 2
    account_warnings_min: int = 3
    database_min: int = 5
    spike_min_events: int = 10
    spike_critical_min: int = 3
    spike_warning_min: int = 5
    keep_events: int = 20
    keep_evidence: int = 5
    evidence_chars: int = 200

    def __post_init__(self) -> None:
        if self.window_s % self.slide_s:
            raise ValueError("window_s must be a multiple of slide_s")


@dataclass(frozen=True)
class IncidentConfig:
    cooldown_s: int = 300
    summary_chars: int = 300
    explanation_chars: int = 1000
    evidence_chars: int = 500
    max_evidence: int = 10
    max_event_ids: int = 50
    max_logs: int = 10


@dataclass(frozen=True)
class NotifyConfig:
    channels: tuple[str, ...] = ("dashboard",)
    rate_limit: int = 10
    rate_window_s: int = 60
    pending_max: int = 100


@dataclass(frozen=True)
class LockoutConfig:
    attempts: int = 5
    window_s: int = 300


@dataclass(frozen=True)
class Retention:
    """Days kept per table. ``None`` keeps the table whole; incidents go only when closed if ``closed_only``."""

    events: int | None = 30
    snapshots: int | None = 30
    deliveries: int | None = 30
    incidents: int | None = 30
    actions: int | None = None
    closed_only: bool = True


TIERED_RETENTION = Retention(events=7, snapshots=30, deliveries=None, incidents=30, actions=90, closed_only=False)
