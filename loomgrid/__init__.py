"""Panel time-series forecasting jobs expressed as Spark DataFrames."""

from loomgrid.config import Settings, SeriesSpec

__version__ = "0.1.0"
__all__ = ["SeriesSpec", "Settings", "__version__"]
