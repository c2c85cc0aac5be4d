"""``sparkpress.functions.textkernel`` under the name that the corpus operators use."""

import sys

from ..functions import textkernel

sys.modules[__name__] = textkernel
