"""DataFrame operators: history builders, labels, preprocessing, estimators,
blends and evaluation.  Each takes and returns DataFrames keyed by the
transition columns ``index_event, outcome_event``."""
