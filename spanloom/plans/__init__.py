"""Queries: the catalogue that __spark_entry__ registers, each beside its SQL where SQL can say it."""
