"""Movement and visit analytics on PySpark."""
