"""PySpark operators for imaging measurements and the traces of the runs that made them."""

__version__ = "0.1.0"
