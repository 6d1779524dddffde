"""Operators for training-data pipelines, one module per operator.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames, reads only the columns it names (extra columns, also ones
with clashing names, never get in the way) and keeps intermediate tables in the
shared folder of ``spark.checkpoint.dir``.
"""
