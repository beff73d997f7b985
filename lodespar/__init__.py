"""Set-oriented key-value, transaction and telemetry analytics on PySpark DataFrames."""
