"""Record linkage, register quality and corpus preparation as PySpark jobs."""
