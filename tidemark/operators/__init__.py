"""All stream operators."""

from tidemark.operators.stateful import *  # noqa: F403
from tidemark.operators.stateless import *  # noqa: F403
from tidemark.operators.windows import *  # noqa: F403
