"""ledgerlane — order-event analytics as Spark DataFrame and Structured Streaming jobs.

Subpackages:

* ``sources``   — table adapters, the order-event stream source, the synthetic generator
* ``functions`` — column expressions: JSON codec, event text, order numbers, decimals
* ``operators`` — placement pipeline, metrics, the distributed ordered prefix sum, sinks
* ``plans``     — the query catalogue (``queries``) and its DuckDB oracle SQL
* ``streaming`` — streaming twins of the metrics, stateful processors, the dashboard job
"""

from ledgerlane.session import build_session, shared_path, shared_root

__all__ = ["build_session", "shared_path", "shared_root"]
