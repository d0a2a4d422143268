"""Column functions."""

from .calendar import *  # noqa: F401,F403
from .labels import *  # noqa: F401,F403
from .ratios import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
