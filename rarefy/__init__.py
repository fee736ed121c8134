"""Spark-native tensor analytics: mostly-empty n-dimensional arrays as DataFrames.

The names of ``rarefy.api`` are the package's own; they load when first used, so that workers
that need one module of the package don't import all of it.
"""

from importlib import import_module


def __getattr__(name):
    if name.startswith("__") and name not in ("__array_api_version__", "__array_namespace_info__"):
        raise AttributeError(name)
    value = getattr(import_module(".api", __name__), name)
    globals()[name] = value
    return value


def __dir__():
    return sorted(set(globals()) | set(dir(import_module(".api", __name__))))
