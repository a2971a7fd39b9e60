"""Training-data operators: one module per operator, plus shared helpers.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""
