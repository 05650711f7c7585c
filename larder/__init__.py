"""larder: order, costing and sales analytics for a made-to-order kitchen, on Spark.

Every operator is DataFrame in, DataFrame out. Work runs as Spark SQL column
expressions on executors; money stays exact decimal until a report's edge.
"""

from larder.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
