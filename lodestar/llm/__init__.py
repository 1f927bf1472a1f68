"""Training-data operators for corpora far larger than one machine.

Every operator takes and returns DataFrames, reads inputs only through Spark,
and names its columns as parameters, so extra columns of the input never clash
with its own.  Nothing outside this subpackage imports it.
"""
