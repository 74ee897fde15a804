"""Panel and time-series research operators expressed as Spark DataFrame plans."""

from tidepanel.session import build_session

__all__ = ["build_session"]
