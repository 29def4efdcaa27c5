"""Readers and writers: the event log, the per-transition file layout, sinks."""

from eventsurv.sources.events import (
    ACTION_OF_TYPE, INDEX_ACTIONS, OUTCOME_ACTIONS, HISTORY_ACTIONS,
    load_events, read_table, transition_pairs,
)

__all__ = [
    "ACTION_OF_TYPE", "INDEX_ACTIONS", "OUTCOME_ACTIONS", "HISTORY_ACTIONS",
    "load_events", "read_table", "transition_pairs",
]
