"""tidewatch: entity behaviour analytics as Spark DataFrame operators.

Every operator is a function from DataFrame to DataFrame (or returns a small
fitted object that holds DataFrames).  Work runs on executors; the driver only
walks schemas, builds plans and reads one-row fit results.
"""

from tidewatch.session import get_spark, scratch_dir, ensure_checkpoint_dir

__all__ = ["get_spark", "scratch_dir", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
