"""pulsegrid: fleet uptime analytics as Spark DataFrame jobs.

Layout
------
``sources``    readers: test-table adapters, heartbeat files, import sheets,
               attachment listings.
``functions``  column expressions (validation predicates, time formats,
               JSON decode rules). No Python UDFs.
``operators``  DataFrame -> DataFrame operators (uptime, registry, import,
               messages, exports).
``streaming``  Structured Streaming jobs built from the same operators.
``plans``      the named query catalogue and its SQL oracle.
"""

from pulsegrid.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
