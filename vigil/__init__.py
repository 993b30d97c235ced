"""vigil — operational analytics as Spark DataFrame operators.

Time-series features, anomaly scoring, evaluation and incident analytics
expressed with the DataFrame / SQL API so Catalyst plans them and the work
stays distributed.
"""

from vigil.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
