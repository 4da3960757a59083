"""Incremental event processing on PySpark: offsets, bounded fetches, commits and replays."""

from tidemark.consumer import Consumer
from tidemark.schemas import EVENTS, LEDGER, OFFSETS
from tidemark.sources.store import OffsetStore

__all__ = ["Consumer", "OffsetStore", "EVENTS", "OFFSETS", "LEDGER"]
