"""JSON encode / decode rules for the message topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timefmt import rfc3339_text, to_utc_ntz

# Fixed value: RFC3339 shape required of a heartbeat timestamp (date, 'T',
# time, optional fraction, 'Z' or a numeric offset).
RFC3339_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"


_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parsed_json(messages: DataFrame, value_col: str = "value", keep: str = "seq") -> DataFrame:
    """(keep, m, fields): the messages that are exactly one JSON object, as
    variant ``m`` and as their members ``fields`` in the order of the text.

    A message is read as the first element of a list whose second is the
    digest of the message. No text can hold its own digest, so the digest is
    the second element only if the message is one whole JSON value: text after
    it, unbalanced brackets and further values make it another or none. The
    generators keep a parse from being inlined into every later reference.
    """
    digest = F.sha2(value_col, 256)
    pair = F.from_json(F.concat(F.lit("["), F.col(value_col), F.lit(',"'), digest, F.lit('"]')),
                       "array<variant>", _STRICT)
    rows = messages.select(F.col(keep), F.inline(F.array(F.struct(
        pair.alias("p"), F.col(value_col).alias("text"), digest.alias("digest")))))
    one = rows.where(F.try_variant_get(F.get("p", 1), "$", "string") == F.col("digest"))
    objects = one.where(F.schema_of_variant(F.get("p", 0)).startswith("OBJECT"))
    fields = F.map_entries(F.from_json("text", "map<string,variant>", _STRICT))
    return objects.select(keep, F.inline(F.array(F.struct(F.get("p", 0).alias("m"), fields.alias("fields")))))


def members(variant: Column) -> Column:
    """Members of a nested object, by name (the text's order is not kept
    there); none of a value that is no object."""
    return F.map_entries(F.try_variant_get(variant, "$", "map<string,variant>"))


def named(fields: Column | str, name: str) -> Column:
    """Values of the members of this name in any case, in order (the long s and
    the Kelvin sign are cases of s and k)."""
    same = F.filter(fields, lambda e: F.lower(F.translate(e["key"], "\u017f\u212a", "sk")) == name.lower())
    return F.coalesce(F.transform(same, lambda e: e["value"]), F.array().cast("array<variant>"))


def like(fields: Column | str, name: str, pattern: str) -> Column:
    """Whether every member of this name has a type that matches."""
    return F.forall(named(fields, name), lambda v: F.coalesce(F.schema_of_variant(v).rlike(pattern), F.lit(True)))


def last(fields: Column | str, name: str) -> Column:
    """The last of the members of this name that is not null."""
    given = F.filter(named(fields, name), lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")) != "VOID")
    return F.try_element_at(given, F.lit(-1))


def is_text(fields: Column | str, name: str) -> Column:
    """Whether every member of this name is a string or null."""
    return like(fields, name, "^(STRING|VOID)$")


def text(fields: Column | str, name: str) -> Column:
    """The text of the last member of this name that is not null, else ''."""
    return F.coalesce(F.try_variant_get(last(fields, name), "$", "string"), F.lit(""))


def _texts(messages: DataFrame, value_col: str, fields: dict[str, str]) -> DataFrame:
    """(seq, column...): the messages whose members ``fields`` are all text."""
    m = parsed_json(messages, value_col)
    for name in fields.values():
        m = m.where(is_text("fields", name))
    return m.select("seq", F.inline(F.array(F.struct(*[text("fields", n).alias(c) for c, n in fields.items()]))))


def decode_heartbeats(messages: DataFrame, value_col: str = "value",
                      seq_col: str = "seq") -> DataFrame:
    """Message log (seq, value) -> heartbeats (seq, server_id, status, ts).

    A message is dropped when it is not exactly one JSON object, when a field
    has another type than text, when its timestamp is missing, not
    RFC3339-shaped or not a real instant. Members are matched in any case; of
    repeated ones the last that is not null counts, and all must be text or
    null. A missing or null id / status becomes ''. Fractions beyond
    microseconds are truncated. ``ts`` is the UTC wall clock as TIMESTAMP_NTZ
    (use ``event_time`` for streams).
    """
    rows = _texts(messages.withColumnRenamed(seq_col, "seq"), value_col,
                  {"server_id": "server_id", "status": "status", "timestamp": "timestamp"})
    instant = F.regexp_replace("timestamp", r"(\.\d{6})\d+", "$1").try_cast("timestamp")
    return (rows.where(F.col("timestamp").rlike(RFC3339_SHAPE) & instant.isNotNull())
            .select("seq", "server_id", "status", to_utc_ntz(instant).alias("ts")))


def decode_probe_requests(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Probe request messages (seq, value) -> (seq, server_id, server_name, ip).

    Same rules as for heartbeats; the fields are ServerID, ServerName, IP.
    """
    return _texts(messages, value_col, {"server_id": "ServerID", "server_name": "ServerName", "ip": "IP"})


def heartbeat_json(server_id="server_id", status="status", ts="ts") -> Column:
    """Encode a heartbeat message as the worker publishes it."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.to_json(F.struct(c(server_id).alias("server_id"),
                              c(status).alias("status"),
                              rfc3339_text(c(ts)).alias("timestamp")))


def probe_request_json(server_id="server_id", server_name="server_name", ip="ipv4") -> Column:
    """Probe request: the reference's struct has no JSON tags, so the keys are
    the field names ServerID, ServerName, IP."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.to_json(F.struct(c(server_id).alias("ServerID"),
                              c(server_name).alias("ServerName"),
                              c(ip).alias("IP")))
