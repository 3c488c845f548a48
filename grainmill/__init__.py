"""grainmill: curation, grading, sampling and evaluation analytics on PySpark."""
