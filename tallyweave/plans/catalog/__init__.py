"""The registered queries, grouped by what they read."""

from tallyweave.plans.catalog import bridges, controls, forecast, reads, stored  # noqa: F401
from tallyweave.plans.catalog.base import CATALOG  # noqa: F401
