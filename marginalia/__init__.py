"""Search, audit and upkeep of collections of semi-structured notes, on PySpark DataFrames."""
