"""quern: a PySpark-native engine for evidence-checked document pipelines.

Every operator is a function from DataFrames to a DataFrame. Plans are built from the DataFrame and SQL API, so
Catalyst chooses the physical strategy; Python is used only where Spark has no expression for the semantics.
"""

__version__ = "0.1.0"
