"""``sparkpress.operators.stars`` under the name that the corpus operators use."""

import sys

from ..operators import stars

sys.modules[__name__] = stars
