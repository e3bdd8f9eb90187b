"""scoreloom: scored-run analytics on PySpark (DataFrame in, DataFrame out)."""
