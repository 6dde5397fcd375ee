"""keyloom: a key-value operation-log analytics engine on PySpark DataFrames."""
