"""trailframe: navigation-trajectory data processing on Spark.

Every operator takes DataFrames and gives DataFrames; nothing in the package
holds a table on the driver.  See README.md for the operator list.
"""

from trailframe.config import NavConfig, VideoConfig

__all__ = ["NavConfig", "VideoConfig"]
