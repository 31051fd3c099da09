"""All registered queries."""

from tagweave.catalog import tables, vectors, metrics, sampling, jobs  # noqa: F401
from tagweave.catalog.registry import ORACLES, QUERIES  # noqa: F401
