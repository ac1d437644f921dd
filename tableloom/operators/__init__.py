"""Operators: Spark ML estimators where something is learned, plain functions where a table is reported."""
