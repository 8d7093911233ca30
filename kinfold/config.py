"""Job settings. Every knob that changes a result is here, none is read from hidden state."""

from __future__ import annotations

from dataclasses import dataclass, field

from kinfold.vocabulary import KINDS

LATEST = "latest"
PREFER_OBSERVED = "prefer_observed"


@dataclass(frozen=True)
class Config:
    #: Kinds a profile needs before it is published.
    required_kinds: list[str] = field(default_factory=lambda: list(KINDS))
    #: Also scan raw id and topic as strings of the message.
    scan_metadata: bool = False
    #: ``latest``: the newest block of a kind wins, derived or not.
    #: ``prefer_observed``: a derived block never replaces one read from a message.
    fold_policy: str = LATEST
    #: Rows per export batch.
    batch_rows: int = 1000
    #: Re-read window of the incremental export.
    skew_seconds: int = 0
    #: A join key with more than 1/hot_key_share of all rows is joined apart.
    hot_key_share: int = 256
    #: Folders of a published table; an export rewrites those it has rows for.
    key_buckets: int = 64
