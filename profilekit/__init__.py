"""A data-profiling engine on Spark DataFrames."""

__version__ = "0.1.0"
__all__ = ["Run", "at_path", "documents", "metrics_frame", "open_table", "profile", "profile_errors", "run_package", "validated"]


def __getattr__(name: str):
    """The public names, imported when first used: the command line needs no Spark."""
    homes = {"Run": "runner", "profile": "runner", "metrics_frame": "runner", "at_path": "sources.tables", "open_table": "sources.tables", "documents": "contract.render", "profile_errors": "contract.invariants", "run_package": "package", "validated": "config"}
    if name not in homes:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"profilekit.{homes[name]}"), name)
