"""granary: analytics and corpus-building operators on PySpark DataFrames."""
