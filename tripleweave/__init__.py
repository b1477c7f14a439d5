"""Knowledge graphs from declarative mappings, as Spark DataFrame plans."""
