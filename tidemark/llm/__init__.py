"""Operations of a large-scale training-data pipeline, each a Spark job.

Nothing else in the library imports this subpackage; deleting it leaves the
rest intact.  ``queries.py`` holds the thin ``opN_*`` queries.
"""
