"""Linear mixed models and the analyses built on them, as Spark plans."""

import os

# With several threads the linear algebra library has locked up in a driver that also talks to the JVM.
# This holds only if numpy is not loaded yet, and leaves a setting of the user's as it is.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
