"""Column builders: each takes Columns and returns a Column, so all of them stay inside codegen."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from farepanel import config as C


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- time -----------------------------------------------------------------------------------


def session_label(ts: Column | str) -> Column:
    """AM from 06:00 to 17:59, otherwise PM; null stays null."""
    ts = col(ts)
    return F.when(F.hour(ts).between(6, 17), "AM").when(ts.isNotNull(), "PM")


def session_date(ts: Column | str) -> Column:
    """A batch that starts before 06:00 belongs to the previous day."""
    return (col(ts) - F.expr("INTERVAL '6' HOUR")).cast("date")


def session_key(date: Column | str, label: Column | str) -> Column:
    """Batch ordinal: two per day, AM before PM."""
    return F.unix_date(col(date)) * 2 + (col(label) == "PM").cast("int")


def ui_daypart(ts: Column | str) -> Column:
    ts = col(ts)
    return F.when(F.hour(ts) < 12, "AM").when(ts.isNotNull(), "PM")


def wall_seconds(ts: Column | str) -> Column:
    """Seconds of a wall-clock time, free of any session time zone."""
    ts = col(ts)
    return F.unix_date(ts.cast("date")).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def hours_between(start: Column | str, end: Column | str) -> Column:
    return (wall_seconds(end) - wall_seconds(start)) / F.lit(3600.0)


def hhmm(minute_of_day: Column | str) -> Column:
    minute = col(minute_of_day)
    return F.floor(minute / 60).cast("int") * 100 + minute % 60


def minute_of_day(ts: Column | str) -> Column:
    return F.hour(col(ts)) * 60 + F.minute(col(ts))


# --- bands and maps -------------------------------------------------------------------------


def right_closed_band(value: Column | str, spec: tuple[Sequence[str], Sequence[float]]) -> Column:
    """Label of the (low, high] interval that holds the value; null gives null."""
    labels, edges = spec
    value = col(value)
    chain = F.when(value <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:-1]):
        chain = chain.when(value <= edge, label)
    return chain.when(value.isNotNull(), labels[-1])


def lookup(value: Column | str, table: Mapping) -> Column:
    """Fixed dictionary as a CASE chain: no join, no shuffle."""
    value = col(value)
    items = list(table.items())
    chain = F.when(value == items[0][0], F.lit(items[0][1]))
    for key, result in items[1:]:
        chain = chain.when(value == key, F.lit(result))
    return chain


def price_tier(price: Column | str, route: Column | str, ceilings: Mapping[str, int] | None = None) -> Column:
    price = col(price)
    ceiling = lookup(route, ceilings or C.ROUTE_CEILINGS)
    return (
        F.when(price.isNull(), "soldout")
        .when(ceiling.isNull(), "unknown")
        .when(price <= ceiling, "standard")
        .when(price <= C.EXTREME_FARE, "high")
        .otherwise("extreme")
    )


def market_group(route: Column | str) -> Column:
    route = col(route)
    return (
        F.when(route.isin(*C.TRUNK_ROUTES), "TRUNK")
        .when(route.isin(*C.TOURISM_ROUTES), "TOURISM")
        .otherwise("REGIONAL_ALTERNATIVE")
    )


def is_peak(date: Column | str, periods: Sequence[tuple[str, str]] = C.PEAK_PERIODS) -> Column:
    """1 inside a listed period; a handful of fixed ranges, so a predicate and not a range join."""
    date = col(date)
    hit = F.lit(False)
    for start, end in periods:
        hit = hit | date.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return hit.cast("int")


def next_dud(dud: Column | str, windows: Sequence[int] = C.BOOKING_WINDOWS) -> Column:
    return lookup(dud, dict(zip(windows[:-1], windows[1:])))


def transition(current: Column | str, target: Column | str) -> Column:
    return F.concat_ws("->", col(current).cast("string"), col(target).cast("string"))


# --- clock and logs -------------------------------------------------------------------------


def clock_sin(minute: Column | str) -> Column:
    return F.sin(col(minute) * F.lit(2 * math.pi) / F.lit(1440.0))


def clock_cos(minute: Column | str) -> Column:
    return F.cos(col(minute) * F.lit(2 * math.pi) / F.lit(1440.0))


def safe_log(value: Column | str) -> Column:
    """Natural log of a positive value, null otherwise."""
    value = col(value)
    return F.when(value > 0, F.ln(value.cast("double")))


def safe_log1p(value: Column | str) -> Column:
    """log(1+x) with x clipped at zero; null stays null."""
    value = col(value).cast("double")
    return F.when(value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0))))


def safe_log_ratio(a: Column | str, b: Column | str) -> Column:
    """log(a/b), both clipped at one; null if either is null."""
    a, b = col(a).cast("double"), col(b).cast("double")
    one = F.lit(1.0)
    return F.when(a.isNotNull() & b.isNotNull(), F.ln(F.greatest(a, one) / F.greatest(b, one)))


# --- labels ---------------------------------------------------------------------------------


def movement_band(price: Column | str, previous: Column | str, legal: Column | str) -> Column:
    """Signed change band against the carried price, first match wins."""
    move = F.try_divide(col(price).cast("double"), col(previous).cast("double")) - 1
    return (
        F.when(~F.coalesce(col(legal).cast("boolean"), F.lit(False)), "NO_LEGAL_CARRY")
        .when(move <= -0.10, "DROP_GE_10PCT")
        .when(move <= -0.05, "DROP_5_10PCT")
        .when(F.abs(move) <= 0.01, "STABLE_LE_1PCT")
        .when(move < 0.05, "MILD_WITHIN_5PCT")
        .when(move < 0.10, "RISE_5_10PCT")
        .otherwise("RISE_GE_10PCT")
    )


def drop_label(price: Column | str, target: Column | str, fraction: float = 0.05) -> Column:
    return (col(target) <= F.lit(1.0 - fraction) * col(price)).cast("int")


def event_label(price: Column | str, target: Column | str, kind: str, fraction: float, amount: float) -> Column:
    """One drop-event definition; a zero-fraction definition is strict, the rest include the boundary."""
    price, target = col(price).cast("double"), col(target).cast("double")
    saving = price - target
    relative, absolute = price * F.lit(float(fraction)), F.lit(float(amount))
    if kind == "PCT" and fraction == 0:
        return (saving > 0).cast("int")
    limit = {
        "PCT": lambda: relative,
        "VND": lambda: absolute,
        "MIN": lambda: F.least(relative, absolute),
        "MAX": lambda: F.greatest(relative, absolute),
    }[kind]()
    return (saving >= limit).cast("int")


def direction3(change_pct: Column | str, deadband: float = 0.01) -> Column:
    """-1, 0, 1 around a dead band expressed in the unit of the column."""
    change = col(change_pct)
    return F.when(change < -deadband, -1).when(change > deadband, 1).when(change.isNotNull(), 0)


def bridge_stability(source_era, target_era, price, target_price) -> Column:
    """Whether a cross-era drop label survives a five percent source difference."""
    bridge = (col(source_era) == C.FLI_ERA) & (col(target_era) == C.TRIP_ERA)
    low = F.lit(0.95) * F.lit(0.95) * col(price)
    high = F.lit(0.95) * F.lit(1.05) * col(price)
    return (
        F.when(~bridge, "NOT_BRIDGE")
        .when(col(target_price) <= low, "ROBUST_DROP")
        .when(col(target_price) > high, "ROBUST_NO_DROP")
        .otherwise("AMBIGUOUS_WITHIN_SOURCE_5PCT")
    )


# --- identities -----------------------------------------------------------------------------


def token(*columns: Column | str) -> Column:
    """Stable text identity; nulls are visible, so two rows never collapse by accident."""
    return F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("__NA__")) for c in columns])


def flight_no_clean(flight_no: Column | str) -> Column:
    return F.regexp_replace(F.trim(col(flight_no)), r"\.0$", "")


def schedule_fallback(flight_no: Column | str, airline: Column | str, departure_hhmm: Column | str) -> Column:
    """True when the number is only AIRLINE-HHMM."""
    text = F.concat_ws("-", col(airline), F.lpad(col(departure_hhmm).cast("string"), 4, "0"))
    return F.coalesce(F.upper(flight_no_clean(flight_no)) == F.upper(text), F.lit(False))


def verified_flight_no(flight_no: Column | str, airline: Column | str, departure_hhmm: Column | str) -> Column:
    digits = F.coalesce(F.regexp_replace(flight_no_clean(flight_no), r"\D", ""), F.lit(""))
    return F.when(~schedule_fallback(flight_no, airline, departure_hhmm), F.concat(col(airline), digits))


# --- quantile arrays ------------------------------------------------------------------------


def rearrange(values: Column | str) -> Column:
    """Running maximum of an array, so quantiles never cross."""
    values = col(values)
    # folded, since an array expression named inside a lambda is computed again for every element
    longer = lambda done, v: F.concat(done, F.array(F.greatest(F.get(done, F.size(done) - 1), v)))
    return F.aggregate(values, F.slice(values, 1, 0), longer)


def crossing(values: Column | str) -> Column:
    """1 when an array decreases anywhere."""
    values = col(values)
    return F.exists(
        F.sequence(F.lit(2), F.size(values)), lambda i: F.element_at(values, i) < F.element_at(values, i - 1)
    ).cast("int")


def pinball_mean(y: Column | str, values: Column | str, levels: Sequence[float] = C.QUANTILES) -> Column:
    """Mean pinball loss over the levels of one row, quantiles taken as given."""
    y, values = col(y), col(values)
    total = F.lit(0.0)
    for index, level in enumerate(levels):
        error = y - values.getItem(index)
        total = total + F.greatest(F.lit(level) * error, F.lit(level - 1.0) * error)
    return total / F.lit(float(len(levels)))


def wis(y: Column | str, values: Column | str, levels: Sequence[float] = C.QUANTILES) -> Column:
    """Weighted interval score of rearranged quantiles."""
    return F.lit(2.0) * pinball_mean(y, values, levels)


# --- decisions ------------------------------------------------------------------------------


def policy_regret(price, target, wait: Column, friction: Column | float) -> Column:
    """Paid minus the cheaper of buying now and buying later; null when an input is null."""
    price, target = col(price).cast("double"), col(target).cast("double")
    friction = friction if isinstance(friction, Column) else F.lit(float(friction))
    later = target + friction
    paid = F.when(wait, later).otherwise(price)
    return F.when(
        price.isNotNull() & target.isNotNull(), F.greatest(paid - F.least(price, later), F.lit(0.0))
    )


def asymmetric_cost(price, target, wait: Column, weight: float, friction: float) -> Column:
    price, target = col(price).cast("double"), col(target).cast("double")
    zero = F.lit(0.0)
    return F.when(wait, F.greatest(target - price, zero) + F.lit(float(friction))).otherwise(
        F.lit(float(weight)) * F.greatest(price - target, zero)
    )
