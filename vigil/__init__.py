"""Log analytics and incident detection as PySpark DataFrame programs."""
