"""txnscope: transaction-risk analytics as plain Spark DataFrame functions.

Sub-packages
------------
sources    readers, writers, adapters and row checks (S*)
functions  column expressions: calendar, amount, flags, scoring (T, A, D, I, P)
operators  windowed features, splits, metrics, summaries, detectors, models
plans      the registered query catalogue and its SQL twins
streaming  Structured Streaming versions of the feature and scoring jobs
"""

__version__ = "0.1.0"
