"""hearsay: daily post analytics as PySpark jobs.

Every operator is a ``DataFrame -> DataFrame`` function. Chain them with
``df.transform``; nothing runs until a sink or an action asks for rows.
"""

from hearsay.config import Settings
from hearsay.session import build_session, shared_scratch

__all__ = ["Settings", "build_session", "shared_scratch"]
