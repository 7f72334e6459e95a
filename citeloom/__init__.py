"""Analytics over corpora of documents that cite one another, on Spark DataFrames."""
