"""Operators of a training-data pipeline. Nothing else in the library imports
this subpackage; its queries are registered by the entry module alone."""
