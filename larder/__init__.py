"""larder: product-label data work on Spark.

Import, normalise, validate, build, score, detect, rank and search a product
catalogue as DataFrame jobs.  Every operator takes DataFrames and returns a
DataFrame; thresholds, dictionaries and dates are arguments.
"""
