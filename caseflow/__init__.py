"""caseflow: case documents to governed, queryable case tables on Spark.

Layers (all plain DataFrame functions):

* ``sources``   - file / table ingest into bronze ``(case_ref, parsed_text)``
* ``functions`` - Column-level building blocks (regexes, checksum, masks)
* ``operators`` - extraction, gold build, governance, analytics, serving,
                  operational state, similarity search, routing, generator
* ``plans``     - fixtures bound to the driver tables and the query registry
* ``streaming`` - incremental forms of ingest, gold, trend and state
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle caseflow functions by value, so the Python functions Spark runs
    on executors (model calls, parsers, k-NN scans) carry their own code and
    workers need no installed copy of this package."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark is a hard dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
