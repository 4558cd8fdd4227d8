"""Shared scratch tables and shipping of this package to executors, as the engine does it."""

from __future__ import annotations

from flowloom.sources.scratch import scratch_path, shared_dir, ship, written

__all__ = ["scratch_path", "shared_dir", "ship", "written"]
