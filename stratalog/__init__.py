"""stratalog: a deductive query engine on Spark SQL."""

from stratalog.database import Database
from stratalog.functions.aggregators import Builtin, Folded
from stratalog.functions.callbacks import Expand, Filter, Rows
from stratalog.lang.parser import parse, parse_files

__all__ = ["Builtin", "Database", "Expand", "Filter", "Folded", "Rows", "parse", "parse_files"]
