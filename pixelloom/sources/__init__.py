"""Sources and sinks: image collections as DataFrames."""
