"""Column-level functions: scalars and chunk-aware time-series windows."""
