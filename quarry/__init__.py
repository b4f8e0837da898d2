"""quarry: table-quality, drift, feature-prep and model-evaluation operators on Spark DataFrames.

Every operator takes DataFrames and returns a lazy DataFrame (or a small driver-side
value computed from a bounded one-row aggregate).  Work is expressed with the DataFrame
API so Catalyst prunes columns, pushes filters and plans partial aggregation.
"""

__version__ = "0.1.0"
