"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when the folder is there.
"""
