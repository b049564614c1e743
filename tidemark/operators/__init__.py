"""Distributed algorithms: DataFrame in, DataFrame out."""
