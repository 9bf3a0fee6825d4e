"""A PySpark engine for finite-horizon decision problems over dice multisets, and its statistics."""
