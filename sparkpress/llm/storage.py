"""``sparkpress.storage`` under the name that the corpus operators use."""

import sys

from .. import storage

sys.modules[__name__] = storage
