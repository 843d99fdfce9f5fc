"""Column expressions (JVM-side, codegen'd)."""

from pulsegrid.functions.predicates import (  # noqa: F401
    email_ok, ipv4_ok, page_request_error, report_request_error, probe_status,
)
from pulsegrid.functions.timefmt import (  # noqa: F401
    format_time, second_floor, ts_literal,
)
