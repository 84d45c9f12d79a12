"""A catalogue of media files and their model-given tags, as PySpark DataFrame jobs."""
