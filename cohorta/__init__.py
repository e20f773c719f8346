"""cohorta — contact segmentation and campaign analytics on Spark.

Every operator is a DataFrame -> DataFrame function built from Spark's
own Column expressions; the jobs in ``cohorta.plans`` read and write
Parquet tables laid out by ``cohorta.sources.warehouse``.
"""

__version__ = "0.1.0"
