"""All registered queries."""

from tidemark.queries import decisions, detection, histories, injection, repair, scores, sources, streams  # noqa: F401
from tidemark.queries.registry import ORACLES, QUERIES  # noqa: F401
