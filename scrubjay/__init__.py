"""Privacy and text hygiene at dataset scale, on PySpark."""
