"""Pool-based screening, selection and evaluation on Spark DataFrames."""
