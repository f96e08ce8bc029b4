"""Source mixes: fractions of sources' characters, solved to targets and filled by ordered prefixes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.plans.prefix_sum import nearest_prefix


def check_entries(entries: list[dict]) -> list[dict]:
    """Each entry has a name, a fraction in 0..1, a fraction_mode, and one of include_sources and exclude_sources."""
    out, names = [], set()
    for e in entries:
        name, fraction, mode = e.get("name"), e.get("fraction"), e.get("fraction_mode", "of_group")
        if not name or name in names:
            raise ValueError(f"source mix entries need names of their own: {name!r}")
        if not isinstance(fraction, int | float) or not 0 <= fraction <= 1:
            raise ValueError(f"entry {name!r}: the fraction must be between 0 and 1")
        if mode not in ("of_group", "of_total"):
            raise ValueError(f"entry {name!r}: unknown fraction_mode {mode!r}")
        include, exclude = e.get("include_sources") or ([e["source_dataset"]] if e.get("source_dataset") else None), e.get("exclude_sources")
        if (include is None) == (exclude is None):
            raise ValueError(f"entry {name!r}: name either sources to include or sources to exclude")
        names.add(name)
        out.append({"name": name, "fraction": float(fraction), "fraction_mode": mode, "include": include, "exclude": exclude})
    return out


def solve(entries: list[dict], available: dict[str, int]) -> dict[str, float]:
    """Characters asked of each entry. of_group entries ask for a part of what they have; of_total entries for a part of the whole mix."""
    fixed = {e["name"]: available[e["name"]] * e["fraction"] for e in entries if e["fraction_mode"] == "of_group"}
    shares = [e for e in entries if e["fraction_mode"] == "of_total"]
    if not shares:
        return fixed
    total, share = sum(fixed.values()), sum(e["fraction"] for e in shares)
    if total > 0:
        if share >= 1:
            raise ValueError("of_total fractions must sum to less than 1 beside of_group entries")
        whole = total / (1 - share)
    else:
        if not math.isclose(share, 1, rel_tol=1e-9, abs_tol=1e-9):
            raise ValueError("of_total fractions alone must sum to 1")
        whole = min(available[e["name"]] / e["fraction"] for e in shares if e["fraction"] > 0)
    for e in shares:
        if whole * e["fraction"] > available[e["name"]] + 1e-6:
            raise ValueError(f"entry {e['name']!r} has too few characters for its share")
        fixed[e["name"]] = whole * e["fraction"]
    return fixed


def apply_mix(docs: DataFrame, entries: list[dict], chars: str, order: list[str], source: str = "source_dataset") -> DataFrame:
    """The rows that the mix takes, with ``component``. The driver sees one sum for each source."""
    entries = check_entries(entries)
    sums = {r[0]: (r[1], r[2]) for r in docs.groupBy(source).agg(F.sum(chars), F.count(F.lit(1))).collect()}
    chosen = {e["name"]: [s for s in sums if (s in e["include"] if e["include"] is not None else s not in e["exclude"])] for e in entries}
    seen: set = set()
    for e in entries:
        if not chosen[e["name"]]:
            raise ValueError(f"entry {e['name']!r} matches no rows")
        if seen & set(chosen[e["name"]]):
            raise ValueError(f"entry {e['name']!r} overlaps an entry before it")
        seen |= set(chosen[e["name"]])
    available = {name: sum(sums[s][0] or 0 for s in of) for name, of in chosen.items()}
    asked = solve(entries, available)
    # Components and targets of the sources, then one ordered prefix for each component.
    component = target = F.lit(None)
    for e in entries:
        asks = math.floor(asked[e["name"]] + 1e-9)
        whole = e["fraction"] >= 1 or asks >= available[e["name"]]
        named = [x for x in chosen[e["name"]] if x is not None]
        mine = F.coalesce(F.col(source).isin(*named), F.lit(False)) if named else F.lit(False)
        mine = mine | F.col(source).isNull() if None in chosen[e["name"]] else mine
        component = F.when(mine, F.lit(e["name"])).otherwise(component)
        target = F.when(mine, F.lit(None if whole else asks).cast("long")).otherwise(target)
    marked = docs.withColumns({"component": component, "__target": target}).where("component is not null")
    taken = nearest_prefix(marked.where("__target > 0"), chars, order, F.col("__target"), ["component"])
    return marked.where("__target is null").unionByName(taken).drop("__target")
