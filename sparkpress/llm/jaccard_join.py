"""``sparkpress.operators.jaccard_join`` under the name that the corpus operators use."""

import sys

from ..operators import jaccard_join

sys.modules[__name__] = jaccard_join
