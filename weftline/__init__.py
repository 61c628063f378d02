"""weftline: language-annotation and sequence-analytics dataflows on PySpark DataFrames."""
