"""Scalar functions of the domain as column expressions; all run inside code generation but for one similarity."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.8
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle miles; NULL if a coordinate is NULL or out of range."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    fine = lat1.between(-90, 90) & lat2.between(-90, 90) & lon1.between(-180, 180) & lon2.between(-180, 180)
    return F.when(fine, EARTH_MILES * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def required_mph(miles: Column, hours: Column) -> Column:
    """Speed that is needed; NULL if there is no time."""
    return F.when(hours > 0, miles / hours)


def em_level(code: Column, given: Column | None = None) -> Column:
    """Level 1-5 of an office visit code, or the level that is given."""
    n = F.when(F.length(code) == 5, code.try_cast("int"))
    found = F.when(n.between(99201, 99205), n - 99200).when(n.between(99211, 99215), n - 99210)
    return found if given is None else F.coalesce(given.cast("int"), found)


def _mapped(code: Column, levels: Mapping[str, int]) -> Column:
    out = F.lit(0)
    for level in sorted(set(levels.values())):
        out = F.when(code.isin(sorted(k for k, v in levels.items() if v == level)), level).otherwise(out)
    return out


#: Office visit codes and their levels in provider features.
_BEHAVIOUR_LEVELS = {"99201": 1, "99202": 1, "99211": 1, "99203": 2, "99212": 2, "99204": 3, "99213": 3, "99205": 4, "99214": 4, "99215": 5}


def em_level_behaviour(code: Column) -> Column:
    """Level by the coding of the provider features; 0 for other codes."""
    return _mapped(F.trim(F.regexp_replace(F.upper(code), "CPT", "")), _BEHAVIOUR_LEVELS)


def em_level_variant(code: Column) -> Column:
    """Level with emergency visits 99281-99285 too; 0 for other codes."""
    n = code.try_cast("int")
    return F.coalesce(em_level(code), F.when(n.between(99281, 99285), n - 99280), F.lit(0))


def has_modifier(modifier: Column, allowed: Iterable[str]) -> Column:
    """Any of a comma-separated list is allowed; NULL: no."""
    return F.coalesce(F.arrays_overlap(F.split(modifier, ","), F.array(*map(F.lit, allowed))), F.lit(False))


def is_any(c: Column, values: Iterable[str]) -> Column:
    """Membership whatever the case; NULL: no."""
    return F.coalesce(F.lower(c).isin([v.lower() for v in values]), F.lit(False))


def has_prefix(c: Column, prefixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return F.coalesce(out, F.lit(False))


def operates_on(day: Column, operating_days: Column) -> Column:
    """The weekday is named in the list; NULL: operating."""
    name = F.element_at(F.array(*map(F.lit, DAYS)), F.weekday(day) + 1)
    return F.coalesce(F.contains(operating_days, name), F.lit(True))


def week_start(day: Column) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", day))


def iso_week(day: Column) -> Column:
    """ISO year and week as ``2024-W03``."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day))


def is_weekend(day: Column) -> Column:
    return (F.weekday(day) >= 5).cast("int")


def paid_ratio(paid: Column, billed: Column) -> Column:
    """Paid over billed within [0, 2]; 1 if nothing was billed."""
    return F.when(billed > 0, F.greatest(F.lit(0.0), F.least(F.lit(2.0), paid / billed))).otherwise(1.0)


def finite(x: Column, default: float = 0.0) -> Column:
    """NULL, NaN and infinities become the default."""
    d = x.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(default)).otherwise(d)


def exact_sum(x: Column, places: int = 6) -> Column:
    """The sum as a double of values rounded to ``places``, added as decimals: the same in any order; NaN and infinities are left out."""
    return F.sum(x.cast("double").try_cast(f"decimal(24,{places})")).cast("double")


def places(x: Column, n: int) -> Column:
    """A number from 0 rounded to ``n`` places: halves go up, also where binary arithmetic leaves them a ten-millionth of a place short."""
    return F.floor(x * 10.0**n + (0.5 + 1e-7)) / 10.0**n


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), finite(x)))


#: Short forms in addresses.
_ADDRESS_TOKENS = {
    "street": "st", "st.": "st", "avenue": "ave", "ave.": "ave",
    "boulevard": "blvd", "blvd.": "blvd", "drive": "dr", "dr.": "dr",
    "lane": "ln", "ln.": "ln", "road": "rd", "rd.": "rd",
    "court": "ct", "ct.": "ct", "circle": "cir", "cir.": "cir",
    "place": "pl", "pl.": "pl", "suite": "ste", "ste.": "ste",
    "apartment": "apt", "apt.": "apt", "building": "bldg", "bldg.": "bldg",
    "floor": "fl", "fl.": "fl", "unit": "unit", "#": "unit",
    "north": "n", "n.": "n", "south": "s", "s.": "s",
    "east": "e", "e.": "e", "west": "w", "w.": "w",
    "northeast": "ne", "ne.": "ne", "northwest": "nw", "nw.": "nw",
    "southeast": "se", "se.": "se", "southwest": "sw", "sw.": "sw",
}


def normal_address(address: Column) -> Column:
    """Lower case, no stops and commas, short forms, single spaces; blank: NULL."""
    text = F.regexp_replace(F.regexp_replace(F.lower(address), r"\.(?!\d)", ""), ",", " ")
    short = F.create_map(*(F.lit(x) for kv in _ADDRESS_TOKENS.items() for x in kv))
    out = F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), lambda t: F.coalesce(F.try_element_at(short, t), t)), " ")
    return F.when(out != "", out)


_SUITE = r"(?i)[,\s]+(?:suite|ste\.?|unit|apt\.?|#)\s*#?\s*([A-Za-z0-9-]+)\s*$"


def split_suite(address: Column) -> tuple[Column, Column]:
    """The address without its suite, and the suite (NULL if none)."""
    suite = F.regexp_extract(address, _SUITE, 1)
    return F.regexp_replace(address, _SUITE, ""), F.when(suite != "", F.lower(suite))


# Fixed values.
_CORPORATE = ("llc", "inc", "corp", "corporation", "co", "company", "ltd", "limited", "pc", "pa", "pllc", "group", "holdings", "associates", "md", "do", "np")


def normal_name(name: Column, strip_corporate: bool = False) -> Column:
    """Lower case without punctuation; of several words optionally without corporate endings. Nothing left: NULL."""
    words = F.filter(F.split(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", ""), r"(?U)\s+"), lambda w: w != "")
    if strip_corporate:
        rest = F.filter(words, lambda w: ~w.isin(list(_CORPORATE)))
        words = F.when(F.size(words) > 1, rest).otherwise(words)
    out = F.array_join(words, " ")
    return F.when(out != "", out)


def _indel(a: str, b: str) -> float:
    """100 · 2·LCS / (|a|+|b|), the longest common subsequence by bit vectors."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_set(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_a or not only_b):
        return 100.0
    base, ta, tb = " ".join(both), " ".join(only_a), " ".join(only_b)
    one, two = f"{base} {ta}".strip(), f"{base} {tb}".strip()
    scores = [_indel(one, two)]
    if both:
        scores += [_indel(base, one), _indel(base, two)]
    return max(scores)


def _token_sets(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x, y) for x, y in zip(a, b)], dtype="float64")


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    """Similarity 0-100 of two names as sets of words; for candidate pairs only."""
    return F.pandas_udf(_token_sets, "double")(a, b)


def tier(x: Column, cuts: Iterable[float], names: Iterable[str]) -> Column:
    """Name of the interval: names has one more than cuts, and a cut belongs to the upper one."""
    names, out = list(names), None
    for cut, name in sorted(zip(cuts, names[1:]), reverse=True):
        out = F.when(x >= cut, name) if out is None else out.when(x >= cut, name)
    return out.otherwise(names[0])


def risk_tier(x: Column) -> Column:
    return tier(x, (0.25, 0.5, 0.75), ("LOW", "MODERATE", "HIGH", "CRITICAL"))


def evidence_tier(x: Column) -> Column:
    return tier(x, (0.25, 0.5, 0.75), ("LOW", "MODERATE", "HIGH", "VERY_HIGH"))


def confidence_tier(x: Column) -> Column:
    return tier(x, (0.4, 0.7), ("LOW", "MEDIUM", "HIGH"))


def queue_tier(x: Column) -> Column:
    return tier(x, (0.35, 0.6, 0.8), ("LOW", "MEDIUM", "HIGH", "CRITICAL"))


def priority_of(risk_tier_col: Column) -> Column:
    return F.when(risk_tier_col == "MODERATE", "MEDIUM").otherwise(risk_tier_col)


def log_dollars(x: Column, cap: float) -> Column:
    """log1p of dollars over log1p of a cap, at most 1."""
    return F.least(F.log1p(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))) / F.log1p(F.lit(float(cap))), F.lit(1.0))


def severity_rank(s: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), s), F.lit(0)).cast("int")


def list_of(text: Column) -> Column:
    """A list from JSON text or comma-separated text; NULL and blank: empty."""
    parsed = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>"))
    plain = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parsed, plain, F.array().cast("array<string>"))


def alert_id(rule_id: str, entity: Column, claim_ids: Column) -> Column:
    """An id that the same finding always gets."""
    return F.concat(F.lit(f"A-{rule_id}-"), F.substring(F.sha2(F.concat_ws("|", F.lit(rule_id), entity.cast("string"), F.array_join(F.array_sort(claim_ids), ",")), 256), 1, 16))


def money(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 2))


#: Wording that generated text must not hold.
PROHIBITED = ("fraud confirmed", "confirmed fraud", "fraudster", "committed fraud", "guilty")


def has_prohibited(text: Column) -> Column:
    out = F.lit(False)
    for p in PROHIBITED:
        out = out | F.contains(F.lower(text), F.lit(p))
    return F.coalesce(out, F.lit(False))
