"""All registered queries."""

from .registry import QUERIES  # noqa: F401
from . import sensor_queries  # noqa: F401
from . import split_queries  # noqa: F401
from . import decision_queries  # noqa: F401
from . import wafer_queries  # noqa: F401
from . import model_queries  # noqa: F401
from . import sink_queries  # noqa: F401
from . import comparison_queries  # noqa: F401
