"""graphloom: structural code-graph analytics on PySpark."""
