"""Knobs, passed as arguments to the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed value: the event type a finished object upload carries.
OBJECT_FINALIZED = "google.cloud.storage.object.v1.finalized"


@dataclass(frozen=True)
class EventKnobs:
    raw_bucket: str = ""  # empty: any bucket
    event_type: str = OBJECT_FINALIZED
    suffix: str = ".pdf"


@dataclass(frozen=True)
class ChunkKnobs:
    size: int = 2000
    overlap: int = 300

    def __post_init__(self):
        if self.size < 1 or not 0 <= self.overlap < self.size:
            raise ValueError(f"overlap {self.overlap} must lie in [0, size {self.size})")


@dataclass(frozen=True)
class EmbedKnobs:
    dim: int = 768
    batch_size: int = 100
    attempts: int = 4
    wait_base: float = 2.0  # waits are base**1, base**2, ... seconds


@dataclass(frozen=True)
class RetrievalKnobs:
    top_k: int = 20
    final_k: int = 8
    rrf_k: int = 60
    n_probe: int = 8


# Upper bounds for what is shipped to every executor. Past them the operators
# take their other way (shuffle join, or several passes).
BROADCAST_ROWS = 500_000  # narrow rows of keys
BROADCAST_BYTES = 64 * 1024 * 1024
