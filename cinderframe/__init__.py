"""Spark-first analytics for gridded incidents, forecasts, fleets and their event logs."""
