"""lakeloom: a PySpark-native analytics engine for point-in-time market and company data.

Subpackages
-----------
functions   column-level helpers (null-safe ratios, windows, transforms, dates)
operators   DataFrame -> DataFrame operators, one module per domain
sources     readers, writers, schemas, the partition manifest
plans       end-to-end pipelines, the query registry and its SQL oracles
streaming   Structured Streaming capture, follow and compaction
"""

__version__ = "0.1.0"
