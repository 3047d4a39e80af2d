"""adperf — Spark-native analytics for daily online-advertising fact tables.

Every operator is a lazy DataFrame -> DataFrame function built from Spark
built-ins.  Sub-packages:

* ``sources``   — readers, writers and the deterministic fixture view
* ``functions`` — shared column expressions (rounding, title case, ratios)
* ``operators`` — profiling, cleaning, KPIs, aggregates, insights, features,
                  evaluation / attribution / diagnostic reports
* ``ml``        — Spark ML training, model search and sampled Shapley values
* ``plans``     — end-to-end pipelines and the query registry
* ``streaming`` — the row-level operators applied to a streaming source
"""

from adperf.session import get_session, materialize

__all__ = ["get_session", "materialize"]
