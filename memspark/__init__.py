"""Analytics for conversational-memory evaluation on PySpark DataFrames."""
