"""Bus frames, registers and log lines: decoding, statistics and symptom ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def j1939(can_id: Column, length: Column) -> dict[str, Column]:
    """Parameter group, priority, source and destination of a 29-bit id; null below three bytes."""
    ok = lambda c: F.when(length >= 3, c)
    return {"pgn": ok(F.shiftright(can_id, 8).bitwiseAND(F.lit(0x3FFFF))), "priority": ok(F.shiftright(can_id, 26).bitwiseAND(F.lit(7))), "source": ok(can_id.bitwiseAND(F.lit(0xFF))), "destination": ok(F.shiftright(can_id, 8).bitwiseAND(F.lit(0xFF)))}


def canopen(can_id: Column, data: Column) -> dict[str, Column]:
    """Node, function code and command byte; null below two bytes. data: binary."""
    ok = lambda c: F.when(F.octet_length(data) >= 2, c)
    return {"node": ok(can_id.bitwiseAND(F.lit(0x7F))), "function": ok(F.shiftright(can_id, 7)), "command": ok(F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("bigint"))}


def register_field(value: Column, offset: int, width: int) -> Column:
    return F.shiftright(value, offset).bitwiseAND(F.lit((1 << width) - 1))


def parse_frame(line: Column) -> dict[str, Column]:
    """'[ts] id#hex', 'CAN: id dlc bytes' and '0xid bytes'; other lines give nulls."""
    forms = [r"^\[(?<t>[0-9.]+)\]\s+(?<i>[0-9A-Fa-f]+)#(?<d>[0-9A-Fa-f]*)$", r"^CAN:\s+()([0-9A-Fa-f]+)\s+[0-9]+\s+([0-9A-Fa-f ]*)$", r"^()0x([0-9A-Fa-f]+)\s+([0-9A-Fa-f ]*)$"]
    forms[0] = forms[0].replace("?<t>", "").replace("?<i>", "").replace("?<d>", "")
    pick = lambda g: F.coalesce(*(F.when(line.rlike(f), F.regexp_extract(line, f, g)) for f in forms))
    return {"ts": F.nullif(pick(1), F.lit("")).try_cast("double"), "can_id": F.conv(pick(2), 16, 10).cast("bigint"), "data": F.unhex(F.regexp_replace(pick(3), " ", ""))}


def parse_log(line: Column) -> dict[str, Column]:
    """'[ts] [level] [source] message'; other lines are INFO of an unknown source."""
    form = r"^\[([^\]]+)\]\s+\[([A-Z]+)\]\s+\[([^\]]+)\]\s+(.*)$"
    ok = line.rlike(form)
    get = lambda g, other: F.when(ok, F.regexp_extract(line, form, g)).otherwise(other)
    return {"time": get(1, F.lit(None)), "level": get(2, F.lit("INFO")), "source": get(3, F.lit("unknown")), "message": get(4, line)}


def group_shares(rows: DataFrame, by: list[Column]) -> DataFrame:
    """Count and share of each group; the total is one row."""
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).withColumn("share", F.round(F.col("n") / F.col("total"), 6)).drop("total")


def cause_score(distance: Column, near: float, window: float, herring: Column, correlated: Column) -> Column:
    """0.4 * (1 - d) within ``near`` seconds, 0.2 within ``window``; halved for red herrings, 0.3 more if correlated, at most 1."""
    base = F.when(distance < near, 0.4 * (1 - distance / near)).when(distance <= window, F.lit(0.2)).otherwise(F.lit(0.0))
    return F.least(base * F.when(herring, 0.5).otherwise(1.0) + F.when(correlated, 0.3).otherwise(0.0), F.lit(1.0))


def hypotheses(text: Column, patterns: list[tuple[str, str]], code: Column, bounds: str = r"(?i)bounds|range check") -> Column:
    """Array of (cause, score): 0.5 for a matching symptom, 0.3 more if the cause stands in the code, 0.2 more with a bounds check."""
    items = [F.when(text.rlike(p), F.struct(F.lit(cause).alias("cause"), (0.5 + F.when(F.lower(code).contains(cause), 0.3).otherwise(0.0) + F.when(code.rlike(bounds), 0.2).otherwise(0.0)).alias("score"))) for p, cause in patterns]
    return F.filter(F.array(*items), lambda x: x.isNotNull())
