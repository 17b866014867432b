"""Options of a reconciliation: Python literals that end up in expressions, never a table."""

from __future__ import annotations

from dataclasses import dataclass, field

TEMP_PREFIX = ".sync.tmp."
STALE_PREFIX = ".sync.stale."


@dataclass(frozen=True)
class SyncOptions:
    """Defaults are those of the job specification."""

    rules: tuple[tuple[str, str], ...] = ()
    mtime_slop_ns: int = 1_000_000
    owner: bool = True
    mode: bool = True
    times: bool = True
    xattrs: bool = True
    posix_acl: bool = True
    nfs4_acl: bool = True
    specials: bool = True
    dry_run: bool = False
    direct_write: bool = False
    hardlinks: str = "preserve"
    max_group_scan: int = 0
    chunk_threshold: int = 24 << 30
    chunk_size: int = 8 << 30
    untranslatable: str = "warn"
    on_mismatch: str = "recopy"
    verify_rate: float = 0.01
    temp_prefix: str = TEMP_PREFIX
    stale_prefix: str = STALE_PREFIX
    max_passes: int = 5
    delta_files_below: int = 0
    delta_bytes_below: int = 0
    mode_name: str = field(default="until_converged")
