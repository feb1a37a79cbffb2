"""Ticket analytics on Spark: label consolidation, priority rules, splitting,
profiling, text features, linear scoring, evaluation, drift and streams.

Every operator is a ``DataFrame -> DataFrame`` function usable with
``df.transform``; the core work runs in Spark SQL / Spark ML / Structured
Streaming.
"""

__version__ = "0.1.0"
