"""ledgerloom: record linkage, point-in-time analytics and corpus preparation on PySpark."""
