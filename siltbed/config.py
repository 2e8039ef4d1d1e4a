"""Settings of a store."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults: a flush at 4 MB of pending log, level 0 compacted from 4 runs on, level 1 beyond 10 MB."""

    flush_bytes: int = 4 << 20
    level0_runs: int = 4
    level1_bytes: int = 10 << 20
    levels: int = 3
    scan_limit: int = 1000
    key_bytes: int = 4096
    index_interval: int = 16
    bloom_bits_per_key: float = 9.6
    bloom_hashes: int = 10
    #: Rows of a run's file: a row group's Bloom filter is sized for as many keys.
    run_ndv: int = 1_000_000
    #: How long files that no longer count stay for readers that may still use them.
    grace_seconds: float = 600
    #: Ingested records come in order of seq. Only then may a compaction drop their tombstones: a late record could be older than one.
    in_order: bool = False
