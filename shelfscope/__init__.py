"""shelfscope: retail product and order insights as lazy Spark DataFrames.

Every public operator takes a DataFrame with canonical column names (see
``shelfscope.operators.schema``) and returns a DataFrame. Nothing is
collected to the driver; the caller decides when to run an action.
"""

from shelfscope.session import get_session

__all__ = ["get_session"]
__version__ = "0.1.0"
