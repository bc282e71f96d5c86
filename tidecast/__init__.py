"""tidecast: repository-activity time series and forecasts as Spark jobs.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects
keyed by a ``repo`` column, so one job handles any number of repositories.
"""

__version__ = "0.1.0"
