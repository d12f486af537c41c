"""encore: listening-history analytics and artist discovery on PySpark.

Every stage is a plain DataFrame -> DataFrame function, so the same code runs
over a whole landed log (batch) and inside a Structured Streaming
``foreachBatch`` micro-batch.
"""

from encore.session import get_session, ensure_checkpoint_dir  # noqa: F401
