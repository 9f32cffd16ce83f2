"""Training-data operators on Spark DataFrames.

Every operator selects the columns it needs before anything else, so extra
columns of the input, whatever their names, neither clash nor travel.
"""
