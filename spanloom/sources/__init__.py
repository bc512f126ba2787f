"""Readers and writers of the text formats of annotated corpora."""
