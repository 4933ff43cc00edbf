"""What the operators need of the session, by the names used here."""

from __future__ import annotations

from millrace.storage import discard, shared_folder, ship, tidy  # noqa: F401
from millrace.storage import materialized as checkpointed  # noqa: F401
