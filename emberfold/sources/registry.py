"""The catalogue of thermal sources: which are read in which mode, and how each is loaded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Source, required, behind a feature flag, enabled.
SOURCES = (("nasa-firms", True, False, True), ("sentinel3a-slstr", False, True, True), ("sentinel3b-slstr", False, True, True), ("mtg-fci-frp", False, True, True), ("msg-seviri-frp", False, True, False))
MODES = ("FIRMS_ONLY", "SEPARATE_SOURCES", "MULTI_SOURCE")


@dataclass
class Registry:
    """Loaders by source; a required source cannot be switched off, one behind a flag only if enabled."""

    loaders: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    enabled: dict[str, bool] = field(default_factory=lambda: {s: on or required for s, required, _, on in SOURCES})

    def register(self, source: str, load: Callable[..., DataFrame]) -> None:
        if not source or not callable(load):
            raise ValueError("a source needs a name and a loader")
        self.loaders[source] = load
        self.enabled.setdefault(source, True)

    def plan(self, mode: str) -> list[str]:
        """Sources that are read in ``mode``: FIRMS_ONLY reads the required ones only."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        required = {s for s, r, _, _ in SOURCES if r}
        return [s for s in self.loaders if (s in required or mode != "FIRMS_ONLY") and self.enabled.get(s)]

    def load(self, mode: str, **request) -> tuple[DataFrame | None, dict[str, str]]:
        """The union of all planned sources and what went wrong by source; one source's failure leaves the others."""
        out, failed = None, {}
        for s in self.plan(mode):
            try:
                df = self.loaders[s](**request)
            except (OSError, ValueError) as e:
                failed[s] = str(e)
                continue
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out, failed
