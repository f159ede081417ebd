"""ledgerlake: batch and Structured Streaming dataflows for order, inventory and
receivables analytics, expressed with the Spark DataFrame API.

Subpackages:
  sources    table binding, event emit/decode/route, sinks
  functions  scalar column helpers and skew-safe window replacements
  operators  the analytical operators (sales, inventory, receivables, ...)
  plans      the named-query catalogue and the query registry
  streaming  file/Kafka event ingest with idempotent, touched-partition refresh
"""

__version__ = "0.1.0"
