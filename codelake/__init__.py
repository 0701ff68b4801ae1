"""codelake: a Spark-native engine for code corpora, retrieval and conversations."""


def _ship_functions_by_value() -> None:
    """Python workers (executors) need the functions this package passes to
    ``mapInPandas`` and Arrow UDFs.  Registering the package with PySpark's
    cloudpickle sends them inside the task payload, so executors need no
    copy of the package installed and no path setup."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - an older cloudpickle: the package must then be installed
        pass


_ship_functions_by_value()
