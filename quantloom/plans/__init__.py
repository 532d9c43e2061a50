"""Registered queries: each module puts its own into the registry when it is imported."""

from . import bars, drift, evidence, feeds, joins, ledger, matrices, recursive, research, rolling, signals, states, statistics, streams, trees, variants  # noqa: F401
