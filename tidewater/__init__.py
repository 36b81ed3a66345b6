"""tidewater: behaviour analytics on Spark DataFrames."""
