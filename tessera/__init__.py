"""A PySpark-native analytics engine: lazy relational, time-series and vector verbs over DataFrames."""
