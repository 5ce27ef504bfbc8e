"""churnscope: workforce-retention analytics expressed as Spark DataFrame plans.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, joins, aggregates and windows, so Catalyst can prune columns, push
filters into the scan and choose join strategies at run time (AQE).
"""

__version__ = "0.1.0"
