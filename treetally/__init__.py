"""Run-ledger analytics and training-data operators as PySpark jobs."""
