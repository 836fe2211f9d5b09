"""The registered queries, by area."""

from taleweave.plans import checking, composed, dealt, further, measured, recorded, scored, searching, state, supposed, texts  # noqa: F401
