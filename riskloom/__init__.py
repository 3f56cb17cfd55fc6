"""riskloom — code-history risk analytics as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` function (usable through
``df.transform``). Sub-packages:

* ``sources``   readers that turn raw commit logs, patches, batches and events
                into tables, and the writers (sinks) for derived tables
* ``functions`` Column -> Column scalar functions (language, ids, hashes,
                outcome, scoring, regex extraction of relationships)
* ``operators`` relational operators: diffs, function blocks, vectors,
                similarity/risk, reverts, graph, clusters, history
* ``streaming`` Structured Streaming forms of the incremental jobs
* ``plans``     the registered end-to-end queries and their SQL twins
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers run the
    operators' pandas/Arrow helpers without having the package installed
    (on a cluster it may still be shipped with --py-files; both work)."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
