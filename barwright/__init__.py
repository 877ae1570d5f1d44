"""Daily market-price analytics on Spark."""

from barwright.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
