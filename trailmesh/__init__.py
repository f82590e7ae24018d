"""A PySpark analytics engine for weighted directed graphs and the event logs of searches over them."""
