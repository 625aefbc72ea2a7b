"""All registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import anomaly, correlation, dialogues, findings, scoring, sets, streams, text, verdicts

_PARTS = (scoring, correlation, streams, text, anomaly, sets, verdicts, findings, dialogues)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
