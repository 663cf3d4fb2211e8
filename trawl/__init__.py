"""trawl — passage-retrieval data operators expressed as Spark DataFrame plans.

Subpackages
-----------
sources    scans of id/text tables and text formats (qrels, runs, triples), sinks, manifests
functions  Column-level helpers: portable hashing, text perturbations, vector math
operators  joins, kNN, mining, triples, ranking, metrics, statistics, quality checks
plans      bindings to the test tables, composite pipelines, the query registry
streaming  incremental (resumable) scoring with Structured Streaming
"""

from trawl.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
