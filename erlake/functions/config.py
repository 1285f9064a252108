"""Settings of experiments: names, run ids, overrides, and the peak memory of a run's driver."""

from __future__ import annotations

import re
import threading
from datetime import datetime, timezone
from pathlib import Path


def experiment_name(name: object) -> str:
    """The name, if it is made of letters, digits, ``_`` and ``-`` alone."""
    if not isinstance(name, str) or not re.fullmatch(r"[a-zA-Z0-9_-]+", name):
        raise ValueError("an experiment's name is made of letters, digits, _ and -")
    return name


def run_id(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y%m%dT%H%M%S.%fZ")


def with_overrides(base: dict, changes: dict) -> dict:
    """A copy of ``base`` with ``changes`` merged in, dictionaries key by key; neither argument changes."""
    out = {k: with_overrides(v, {}) if isinstance(v, dict) else v for k, v in base.items()}
    for k, v in changes.items():
        out[k] = with_overrides(out.get(k) if isinstance(out.get(k), dict) else {}, v) if isinstance(v, dict) else v
    return out


class PeakMemory:
    """Largest resident memory of this process while the block runs, in bytes; None where the system doesn't tell."""

    def __init__(self, every: float = 0.05) -> None:
        self.every, self.peak = every, None

    def _sample(self) -> None:
        while not self._over.wait(self.every):
            self._read()

    def _read(self) -> None:
        status = Path("/proc/self/status")
        found = re.search(r"VmRSS:\s+(\d+) kB", status.read_text()) if status.exists() else None
        if found:
            self.peak = max(self.peak or 0, 1024 * int(found[1]))

    def __enter__(self) -> PeakMemory:
        self._over, self._thread = threading.Event(), threading.Thread(target=self._sample, daemon=True)
        self._read()
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._over.set()
        self._thread.join()
        self._read()
