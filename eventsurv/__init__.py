"""eventsurv: time-to-event analytics on Spark.

Event logs become labelled transitions (index event -> first later outcome
event, censored at the end of the log), get history, calendar and ratio
features, fitted preprocessing, survival labels, survival models, blends and
an exact concordance index.  All transitions live in one keyed DataFrame.
"""

from eventsurv.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
