"""Event-sourced lake analytics on PySpark: operators, projections, search and streaming views."""
