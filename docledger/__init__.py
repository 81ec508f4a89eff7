"""docledger: business-document analytics on PySpark DataFrames."""
