"""ledgerloom: release-evidence analytics and corpus preparation on PySpark."""
