"""Spark-native engine for catalogs of economic time series.

Every operator is a function from DataFrame(s) to a DataFrame; only the
maintenance plans (full rebuild, incremental update, publish) write.
"""

from seriesforge.session import get_session

__all__ = ["get_session"]
