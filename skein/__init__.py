"""skein: code-graph analytics and large-table data processing as PySpark DataFrame plans."""
