"""textflow: text analytics and incident-report linkage as Spark DataFrame jobs.

Subpackages
-----------
sources    -- readers, writers, previews and profiles
functions  -- Column -> Column expressions (incident extractors, pair distances)
operators  -- DataFrame -> DataFrame operators (relational, text, features,
              linkage, learning, evaluation, pipeline stages)
plans      -- composed jobs (incident features, linkage data set, text workflow)
              and the test fixtures derived from the driver tables
streaming  -- the stateless operators run on a file stream
"""

from textflow.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
