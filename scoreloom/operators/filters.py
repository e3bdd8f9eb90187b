"""Row and run predicates (P01 to P18) as one conjunction that reaches the scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def in_range(name: str, low: float | None, high: float | None) -> list[Column]:
    """Null passes only where neither bound is given."""
    return [F.col(name) >= low] * (low is not None) + [F.col(name) <= high] * (high is not None)


def parse_range(text: str) -> tuple[float, float]:
    """P02: "A-B"."""
    try:
        low, high = (float(x) for x in text.split("-"))
    except ValueError:
        raise ValueError(f"not a range: {text!r}") from None
    if low > high:
        raise ValueError(f"not a range: {text!r}")
    return low, high


@dataclass
class RowFilter:
    """All given parts must hold."""

    years: list[int] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    problem_numbers: list[str] = field(default_factory=list)
    reasoning_modes: list[str] = field(default_factory=list)
    predicted: list[str] = field(default_factory=list)
    multimodal: bool | None = None
    correctness: str | None = None
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    has_warnings: bool | None = None
    warning_types: list[str] = field(default_factory=list)

    def condition(self) -> Column:
        out: list[Column] = []
        for name, values in (("year", self.years), ("group", self.groups), ("language", self.languages), ("problem_number", self.problem_numbers), ("reasoning_mode", self.reasoning_modes)):
            if values:
                out.append(F.col(name).isin(*values))
        if self.predicted:
            out.append(F.upper("predicted").isin(*[p.upper() for p in self.predicted]))
        if self.multimodal is not None:
            out.append(F.coalesce("multimodal", F.lit(False)) == self.multimodal)  # P07
        if self.correctness:
            out.append({"true": F.col("is_correct"), "false": ~F.col("is_correct"), "unknown": F.col("is_correct").isNull()}[self.correctness])
        for name, (low, high) in self.ranges.items():
            out += in_range(name, low, high)
        if self.has_warnings is not None:
            out.append((F.coalesce(F.size("warnings"), F.lit(0)) > 0) == self.has_warnings)
        if self.warning_types:
            out.append(F.arrays_overlap("warnings", F.array(*map(F.lit, self.warning_types))))
        return every(out)

    @classmethod
    def parse(cls, given: dict[str, list[str]]) -> RowFilter:
        """From the lists of a query string; a bad number raises ValueError."""
        one = lambda k: given.get(k, [None])[0]
        number = lambda k: float(one(k)) if one(k) not in (None, "") else None
        flag = lambda k: {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get((one(k) or "").lower())
        ranges = {n: (number(f"{n}_min"), number(f"{n}_max")) for n in ("points", "points_earned", "latency_ms", "total_tokens", "cost_usd")}
        return cls(
            [int(x) for x in given.get("years", [])], given.get("groups", []), given.get("languages", []), given.get("problem_numbers", []), given.get("reasoning_modes", []), given.get("predicted", []),
            flag("multimodal"), one("correctness") or None, {k: v for k, v in ranges.items() if v != (None, None)}, flag("has_warnings"), given.get("warning_types", []),
        )


def modality(rows: DataFrame, vision_only: bool = False, text_only: bool = False, sees: bool = True) -> DataFrame:
    """P03; a model that doesn't see gets text only."""
    if vision_only and (text_only or not sees):
        raise ValueError("vision only contradicts text only")
    if vision_only:
        return rows.where("multimodal")
    return rows.where("not coalesce(multimodal, false)") if text_only or not sees else rows


def sampled(rows: DataFrame, n: int, key: str = "id", seed: int | None = None) -> DataFrame:
    """The first n in order of the key, or of its hash where a seed is given."""
    order = [F.xxhash64(key, F.lit(seed)), F.col(key)] if seed is not None else [F.col(key)]
    return rows.orderBy(*order).limit(n)


def run_condition(text: str | None = None, models: list[str] | None = None, modes: list[str] | None = None, has_failures: bool | None = None, date_from: str | None = None, date_to: str | None = None) -> Column:
    """Over the runs table; a bare upper date reaches to the end of its day."""
    out: list[Column] = []
    if text:
        out.append(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in ("run_name", "model", "dataset", "mode")]))
    if models:
        out.append(F.col("model").isin(*models))
    if modes:
        out.append(F.col("mode").isin(*modes))
    if has_failures is not None:
        out.append((F.col("failed") > 0) == has_failures)
    if date_from:
        out.append(F.col("ts") >= scoring.parsed_date(F.lit(date_from)))
    if date_to:
        end = scoring.parsed_date(F.lit(date_to))
        out.append(F.col("ts") < end + F.expr("interval 1 day") if len(date_to.strip()) <= 10 else F.col("ts") <= end)
    return every(out)


def changed(view: str) -> Column:
    """P13, over a joined pair with a_ and b_ columns."""
    same = lambda c: F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    a, b = F.coalesce("a_is_correct", F.lit(False)), F.coalesce("b_is_correct", F.lit(False))
    return {"all": F.lit(True), "changed": ~same("is_correct") | ~same("predicted"), "improved": ~a & b, "regressed": a & ~b}[view]


def tier(share: Column) -> Column:
    """P16."""
    return F.when(share >= 0.95, "excellent").when(share >= 0.75, "good").when(share >= 0.5, "average").when(share.isNotNull(), "below")


def has_extra_images(options: list[str], associated: str | None = None) -> Column:
    """An option image, or an associated one."""
    out = F.coalesce(*[F.col(c) for c in options]).isNotNull()
    return out | (F.coalesce(F.size(associated), F.lit(0)) > 0) if associated else out


@dataclass
class OverviewQuery:
    """P10: what the list of runs is asked for; an unknown sort falls back to time."""

    text: str | None = None
    models: list[str] = field(default_factory=list)
    modes: list[str] = field(default_factory=list)
    has_failures: bool | None = None
    date_from: str | None = None
    date_to: str | None = None
    sort: str = "ts"
    descending: bool = True

    SORTS = ("ts", "accuracy", "answered", "failed")

    @classmethod
    def parse(cls, given: dict[str, list[str]]) -> OverviewQuery:
        one = lambda k: (given.get(k, [None])[0] or "").strip() or None
        sort = one("sort")
        return cls(one("q"), given.get("models", []), given.get("modes", []), {"true": True, "false": False}.get(one("has_failures") or "any"), one("date_from"), one("date_to"), sort if sort in cls.SORTS else "ts", one("order") != "asc")

    def apply(self, runs: DataFrame) -> DataFrame:
        """Nulls sort as the least."""
        rows = runs.where(run_condition(self.text, self.models, self.modes, self.has_failures, self.date_from, self.date_to))
        return rows.orderBy(F.desc_nulls_last(self.sort) if self.descending else F.asc_nulls_first(self.sort), "run_id")
