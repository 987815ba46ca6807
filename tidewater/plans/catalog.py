"""All queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import canon, datasets, desk, evidence, features, market, newsdesk, newsroom, panel, replays, research

QUERIES: dict = {**market.QUERIES, **research.QUERIES, **newsroom.QUERIES, **desk.QUERIES, **panel.QUERIES, **newsdesk.QUERIES, **features.QUERIES, **canon.QUERIES, **datasets.QUERIES, **replays.QUERIES, **evidence.QUERIES}
ORACLES: dict[str, str] = {**market.ORACLES, **research.ORACLES, **newsroom.ORACLES, **desk.ORACLES, **panel.ORACLES, **newsdesk.ORACLES, **features.ORACLES, **canon.ORACLES, **datasets.ORACLES, **replays.ORACLES, **evidence.ORACLES}
