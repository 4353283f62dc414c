"""tidegrid: panel time-series analytics on PySpark, as lazy DataFrame transformations."""
