"""Market analytics for many tickers at once, as Spark DataFrame transformations."""
