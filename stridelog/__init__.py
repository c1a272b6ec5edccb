"""Run-localization analytics on Spark."""
