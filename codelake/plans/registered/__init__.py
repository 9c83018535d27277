"""Registered queries: each operator over the driver tables, with equivalent SQL where there is any."""

from codelake.plans.registered import (  # noqa: F401
    columns,
    delta,
    jobs,
    scans,
    searches,
    statistics,
    symbols,
    text,
)
from codelake.plans.registered.registry import ORACLES, QUERIES  # noqa: F401
