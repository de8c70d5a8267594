"""Registered queries; importing this package fills the registry."""

from leafwise.plans import (  # noqa: F401
    archives,
    catalogue,
    diagnosis,
    documents,
    gaps,
    packages,
    pixels,
    scoring,
    spines,
    streams,
    templates,
)
from leafwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
