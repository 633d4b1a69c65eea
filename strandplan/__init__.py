"""strandplan: fibre access network planning over geospatial tables, on Spark DataFrames."""
