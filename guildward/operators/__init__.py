"""Relational and stateful operators: DataFrame in, DataFrame out."""
