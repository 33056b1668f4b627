"""saldo: national-accounts and input-output analysis on Spark DataFrames."""
