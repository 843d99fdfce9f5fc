"""Validation predicates as built-in column expressions (no UDFs).

Spark's ``rlike`` searches (it does not full-match), so every pattern is
anchored with ``^`` and ``\\z`` (``$`` would also accept a trailing newline).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid import schemas as S

# IPv4 dotted quad as accepted by Go's ParseIP + To4 -- each
# octet 0-255 without leading zeros; IPv4-mapped IPv6 addresses are accepted
# as well, short or in full, with a dotted quad or two groups at the end.
IPV4_OCTET = r"25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]"
IPV4_QUAD = rf"(?:{IPV4_OCTET})(?:\.(?:{IPV4_OCTET})){{3}}"
# Five groups of zero, written out or shortened by one "::", then ffff.
_ZERO = "0{1,4}"
IPV4_MAPPED_PREFIX = (rf"(?:(?:{_ZERO}:){{5}}|::(?:{_ZERO}:){{0,4}}|{_ZERO}::(?:{_ZERO}:){{0,3}}"
                      rf"|(?:{_ZERO}:){{2}}:(?:{_ZERO}:){{0,2}}|(?:{_ZERO}:){{3}}:(?:{_ZERO}:)?"
                      rf"|(?:{_ZERO}:){{4}}:)[Ff]{{4}}:")
IPV4_PATTERN = rf"^(?:{IPV4_QUAD}|{IPV4_MAPPED_PREFIX}(?:{IPV4_QUAD}|[0-9A-Fa-f]{{1,4}}:[0-9A-Fa-f]{{1,4}}))\z"

# Address grammar as Go's mail.ParseAddress reads it -- words of
# atom characters joined by single dots on both sides of the @ (or a quoted
# local part, or a bracketed domain), alone or in <> after an optional name.
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\u0080-\uFFFF-]+"
_DOTTED = rf"{_ATOM}(?:\.{_ATOM})*"
_QUOTED = r'"(?:[^"\\\r\n]|\\.)*"'
_ADDRESS = rf"(?:{_DOTTED}|{_QUOTED})@(?:{_DOTTED}|\[[^\[\]\\\s]*\])"
_NAME = rf"(?:(?:{_DOTTED}|{_QUOTED})[ \t]*)*"
EMAIL_PATTERN = rf"^[ \t]*(?:{_ADDRESS}|{_NAME}<[ \t]*{_ADDRESS}[ \t]*>)[ \t]*\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ipv4_ok(c) -> Column:
    """True when the text is a valid IPv4 address; NULL input -> False."""
    return F.coalesce(_col(c).rlike(IPV4_PATTERN), F.lit(False))


def email_ok(c) -> Column:
    return F.coalesce(_col(c).rlike(EMAIL_PATTERN), F.lit(False))


def page_request_error(from_row, to_row, sort_field) -> Column:
    """Error text of a list/export page request, NULL when valid.

    Checks in the reference's order: sort field first, then the range.
    """
    f, t = _col(from_row).cast("long"), _col(to_row).cast("long")
    sort_ok = F.coalesce(_col(sort_field).isin(*S.SORT_FIELDS), F.lit(False))
    range_bad = (t - f <= 0) | (f < 0) | (t <= 0)
    return (F.when(~sort_ok, F.lit(S.ERR_INVALID_SORT))
             .when(F.coalesce(range_bad, F.lit(True)), F.lit(S.ERR_INVALID_PAGINATION)))


def clamp_page_end(from_row, to_row, width: int = S.MAX_PAGE_WIDTH) -> Column:
    """End of the page after clamping the width to ``width`` rows."""
    f, t = _col(from_row).cast("long"), _col(to_row).cast("long")
    return F.when(t - f > width, f + width).otherwise(t)


def report_request_error(from_ts, to_ts, receivers) -> Column:
    """Error text of a report request (from <= to, >= 1 receiver, each an
    address), NULL when valid. ``from == to`` is accepted (empty report)."""
    rc = _col(receivers)
    n = F.coalesce(F.size(rc), F.lit(0))
    all_ok = F.coalesce(F.forall(rc, lambda x: email_ok(x)), F.lit(True))
    return (F.when(_col(from_ts) > _col(to_ts), F.lit(S.ERR_INVALID_TIME_RANGE))
             .when(n <= 0, F.lit(S.ERR_INVALID_EMAIL))
             .when(~all_ok, F.lit(S.ERR_INVALID_EMAIL)))


def probe_status(error, packets_recv) -> Column:
    """Probe outcome: 'on' only when the probe ran without error and at least
    one packet came back, else 'off'."""
    ok = _col(error).isNull() & F.coalesce(_col(packets_recv) > 0, F.lit(False))
    return F.when(ok, F.lit(S.STATUS_ON)).otherwise(F.lit(S.STATUS_OFF))
