"""Jump-list evidence analysis over tables, as ordinary Spark DataFrame jobs."""
