"""All queries on the library's own operators, and their SQL."""

from . import q_arms, q_evaluate, q_more, q_rest, q_scans, q_search, q_signal, q_text, q_turns  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "r9_select_top"
