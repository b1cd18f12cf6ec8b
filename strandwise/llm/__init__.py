"""Operators that prepare training text. Nothing else in the library imports this."""

import os

# Spark's tasks take the cores; threads of linear algebra beside them only wait. Holds where numpy is not loaded yet.
os.environ.setdefault("OMP_NUM_THREADS", "1")
