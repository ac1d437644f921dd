"""Compositions of operators: preparing a table by configuration, training, search."""
