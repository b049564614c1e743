"""Market, trade and macro time-series analytics as ordinary Spark DataFrame transformations."""
