"""Config audits: placeholder fill (F5) and unresolved-placeholder audit (F6),
template reference extraction (F7), default-secret audit (F24), daemon start /
stop order (O1, O2).

Parameters (fills, well-known secrets) are short literal lists folded into the
expression; the data side is never collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.operators.ranking import DEFAULT_MAX_GROUP_ROWS, row_number_within

PLACEHOLDER = r"<([A-Z_]+)>"

# Passwords the fleet scripts ship with and flag as to be changed.
WELL_KNOWN_SECRETS = ["secret", "soadmin", "zebra", "please-set-at-here"]
SECRET_KEY_PATTERN = "(?i)(pass|secret|token)"
# Fixed value: the routing daemon that keeps its priority (every other enabled
# daemon is moved one step later so it starts first).
PRIORITY_ANCHOR_DAEMON = "zebra"
# Fixed value: an entry of the daemon file that has a priority but is no daemon; only a list that names it schedules it.
NO_DAEMON = "vtysh_enable"


def fill_placeholders(text, params: Sequence[tuple[str, str]] | Mapping[str, str],
                      open_: str = "<", close: str = ">") -> Column:
    """``sed "s/<NAME>/value/g"`` for each parameter in order."""
    items = list(params.items()) if isinstance(params, Mapping) else list(params)
    c = F.col(text) if isinstance(text, str) else text
    for name, value in items:
        c = F.replace(c, F.lit(f"{open_}{name}{close}"), F.lit(value))
    return c


def unresolved_placeholders(df: DataFrame, text_col: str, key_cols: Sequence[str],
                            pattern: str = PLACEHOLDER, name_col: str = "placeholder") -> DataFrame:
    """Names still present, once per occurrence, with their 0-based position."""
    return df.select(*key_cols, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 1)).alias(
        "pos", name_col))


def template_refs(df: DataFrame, text_col: str, key_cols: Sequence[str],
                  patterns: Mapping[str, str], kind_col: str = "kind", ref_col: str = "ref") -> DataFrame:
    """Every reference by pattern kind, once per occurrence.

    ``patterns`` maps a kind to a regex whose group 1 is the reference, e.g.
    ``{"ip": r'\\$(\\w+)\\.IP\\("', "name": r"\\$(\\w+)\\.Name\\(\\)"}``.
    """
    def tagger(kind: str):
        return lambda x: F.struct(F.lit(kind).alias(kind_col), x.alias(ref_col))

    arrays = [F.transform(F.regexp_extract_all(F.col(text_col), F.lit(rx), 1), tagger(kind))
              for kind, rx in patterns.items()]
    return df.select(*key_cols, F.inline(F.concat(*arrays)))


def default_secret_audit(config: DataFrame, key_col: str = "key", value_col: str = "value",
                         key_pattern: str = SECRET_KEY_PATTERN,
                         known: Sequence[str] = tuple(WELL_KNOWN_SECRETS)) -> DataFrame:
    """Secret-like keys, flagged when their value is a well-known default."""
    v = F.trim(F.regexp_replace(F.col(value_col), "^[\"']|[\"']$", ""))
    return (config.where(F.col(key_col).rlike(key_pattern))
                  .withColumn("is_default", v.isin(list(known))))


def normalize_priority(name, value, special: str = PRIORITY_ANCHOR_DAEMON) -> Column:
    """``convert_daemon_prios``: no/empty -> 0, yes/true -> 1, every enabled
    daemon except ``special`` +1; anything non-numeric is never scheduled (null)."""
    n = F.col(name) if isinstance(name, str) else name
    v = F.trim(F.col(value) if isinstance(value, str) else value)
    base = (F.when(v.isNull() | (v == "") | (v == "no"), F.lit(0))
            .when((v == "yes") | (v == "true"), F.lit(1))
            .otherwise(v.try_cast("int")))
    return F.when((n != special) & (base > 0), base + 1).otherwise(base)


def _listed(daemons: DataFrame, name_col: str, daemon_list: Sequence[str] | None) -> tuple[DataFrame, list[Column]]:
    """The daemons of the list and the order of ties it asks for; without a list, every entry that is a daemon."""
    name = F.col(name_col)
    if daemon_list is None:
        return daemons.where(name.isNull() | (name != NO_DAEMON)), []
    names = F.array(*[F.lit(n) for n in daemon_list]) if daemon_list else F.array().cast("array<string>")
    return daemons.where(F.array_contains(names, name)), [F.array_position(names, name)]


def _sequence(df: DataFrame, host_col: str, order: list, seq_col: str, skew_safe, max_group_rows: int) -> DataFrame:
    return row_number_within(df, [host_col], order, seq_col, skew_safe=skew_safe, max_group_rows=max_group_rows)


def start_order(daemons: DataFrame, host_col: str, name_col: str, pos_col: str, prio_col: str,
                wanted: int = 10, seq_col: str = "start_seq", skew_safe: bool | str = "auto",
                max_group_rows: int = DEFAULT_MAX_GROUP_ROWS, daemon_list: Sequence[str] | None = None) -> DataFrame:
    """``start_prio N [list]``: priorities 1..N ascending, ties in list order (O1).

    ``daemon_list`` schedules only the daemons it names, ties in its order; without it every entry but
    ``vtysh_enable``, ties in the order of the host's table.

    The per-host sequence is :func:`row_number_within`: a plain window while
    every host's table is provably small, the distributed numbering (no host in
    one task) otherwise; ``skew_safe`` forces either."""
    listed, ties = _listed(daemons, name_col, daemon_list)
    order = [F.col(prio_col), *ties, F.col(pos_col), F.col(name_col)]
    return _sequence(listed.where(F.col(prio_col).between(1, wanted)), host_col, order, seq_col, skew_safe,
                     max_group_rows)


def stop_order(daemons: DataFrame, host_col: str, name_col: str, pos_col: str, prio_col: str,
               wanted: int = 0, seq_col: str = "stop_seq", skew_safe: bool | str = "auto",
               max_group_rows: int = DEFAULT_MAX_GROUP_ROWS, daemon_list: Sequence[str] | None = None) -> DataFrame:
    """``stop_prio N [list]``: priorities 10 down to N, ties in list order (O2); N=0 includes disabled.

    ``daemon_list`` as for :func:`start_order`."""
    listed, ties = _listed(daemons, name_col, daemon_list)
    order = [F.col(prio_col).desc(), *ties, F.col(pos_col), F.col(name_col)]
    return _sequence(listed.where(F.col(prio_col).between(wanted, 10)), host_col, order, seq_col, skew_safe,
                     max_group_rows)
