"""Training-data operators: dedup, filtering, extraction, scoring, mixing, encoding.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; intermediate tables go to the shared folder that
``spark.checkpoint.dir`` names (see ``common.save``).
"""
