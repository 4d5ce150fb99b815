"""Benchmark analytics as Spark jobs.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame in, DataFrame out), ``streaming``
(Structured Streaming jobs), ``plans`` (end-to-end analyses) and ``queries``
(the operators bound to the shared test tables).
"""
