"""DuckDB building blocks of the twin queries: tape, bars and volatility as common table expressions."""

from __future__ import annotations

TAPE = """tape AS (SELECT event_id, event_type, 'ALL' AS symbol, ts AS ts_utc, value AS bid, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  value + CAST(json_extract_string(props, '$.k') AS INTEGER) * 0.01 AS ask FROM events)"""
M1 = TAPE + """,
m1 AS (SELECT symbol, time_bucket(INTERVAL '1 minute', ts_utc) AS ts_utc, arg_min(bid, event_id) AS open, max(bid) AS high, min(bid) AS low, arg_max(bid, event_id) AS close,
  count(*) AS tick_volume, arg_max(k, event_id) AS spread_points FROM tape GROUP BY ALL)"""


def bars(minutes: int, name: str | None = None, source: str = "m1") -> str:
    return f"""{name or f"m{minutes}"} AS (SELECT symbol, time_bucket(INTERVAL '{minutes} minutes', ts_utc) AS ts_utc, arg_min(open, ts_utc) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts_utc) AS close, CAST(sum(tick_volume) AS BIGINT) AS tick_volume, min(spread_points) AS spread_points_min, max(spread_points) AS spread_points_max, count(*) AS m1_bars
  FROM {source} GROUP BY symbol, time_bucket(INTERVAL '{minutes} minutes', ts_utc))"""


W = "(PARTITION BY symbol ORDER BY ts_utc)"


def last(n: int, until: int = 0, part: str = "symbol") -> str:
    """A frame of the n rows that end ``until`` rows from here."""
    start = n - 1 - until
    end = "CURRENT ROW" if until == 0 else f"{-until} PRECEDING"
    return f"(PARTITION BY {part} ORDER BY ts_utc ROWS BETWEEN {start} PRECEDING AND {end})"


def full(f: str, x: str, n: int, until: int = 0, least: int | None = None, part: str = "symbol") -> str:
    fr = last(n, until, part)
    return f"CASE WHEN count({x}) OVER {fr} >= {n if least is None else least} THEN {f}({x}) OVER {fr} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {W}"


def atr(source: str = "m5", name: str = "v", long: int = 5760, least: int = 1440) -> str:
    """Bars with atr, atr_pts, vol_ratio, event_time and available_at."""
    return f"""{name}_tr AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM {source}),
{name}_mean AS (SELECT *, {full('avg', 'tr', 14)} AS mean_tr FROM {name}_tr),
{name}_atr AS (SELECT *, {lag('mean_tr')} AS atr_raw FROM {name}_mean),
{name}_pts AS (SELECT *, atr_raw / 0.01 AS atr_pts, CASE WHEN atr_raw > 0 THEN atr_raw END AS a FROM {name}_atr),
{name} AS (SELECT *, ts_utc AS event_time, ts_utc + INTERVAL '5 minutes' AS available_at, atr_pts / nullif(greatest({full('median', 'atr_pts', long, least=least)}, 0), 0) AS vol_ratio FROM {name}_pts)"""


M5 = f"{M1},\n{bars(5)}"
V5 = f"{M5},\n{atr()}"
NY = "((ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


def zone(name: str, ts: str = "ts_utc") -> str:
    return f"((({ts}) AT TIME ZONE 'UTC') AT TIME ZONE '{name}')"


def minute(ts: str) -> str:
    return f"(date_part('hour', {ts}) * 60 + date_part('minute', {ts}))"


def pos(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ({x}) END)"


def query(ctes: str, source: str, plain: list[str], rounded: list[str] = (), tail: str = "", places: int = 6) -> str:
    """SELECT with the doubles rounded; entries are 'name' or 'expression AS name'."""

    def cut(item: str) -> str:
        x, _, name = item.rpartition(" AS ")
        return f"round({x or name}, {places}) AS {name}"

    return f"WITH {ctes}\nSELECT {', '.join([*plain, *map(cut, rounded)])} FROM {source} {tail}"
