"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401  (importing registers)
    aggregation, base, cleaning, flows, geography, linkage, reporting, scans,
)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracles() -> dict[str, str]:
    return dict(base.ORACLES)
