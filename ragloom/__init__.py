"""ragloom: retrieval, grounding and evaluation as Spark DataFrame plans."""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions of this package that run inside tasks (mapInPandas scorers, pandas UDFs) are pickled
    by value, so executors need only pyspark/numpy/pandas, not an installed copy of ragloom.
    (Shipping the package with --py-files / addPyFile works as well.)"""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    reg = getattr(cloudpickle, "register_pickle_by_value", None)
    if reg is not None:
        reg(sys.modules[__name__])


_ship_by_value()
