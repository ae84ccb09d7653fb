"""fleetspark: fleet and network analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns) and is built
from Spark SQL expressions, joins, aggregations and windows; nothing runs row
by row in Python.

Layout: ``functions`` (Column expressions), ``operators`` (DataFrame ->
DataFrame), ``sources`` (scans), ``streaming`` (stream forms, sinks),
``plans`` (the registered queries over the driver tables).
"""

from fleetspark.session import checkpoint_dir, cut_lineage, get_spark, parallelism

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage", "parallelism"]
