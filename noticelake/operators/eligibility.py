"""Who may apply for which kind of supply: eight checks of a profile against a rule row, ranks and points.

A check looks at a pair of a profile and a rule and gives whether it passes and whether that is unsure, as the answer hangs
on what the profile does not say. What a rule does not ask for passes. Words are fixed values of the domain.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.operators.relational import small

SINGLE, MARRIED, ENGAGED, ANY = "미혼", "기혼", "예비신혼부부", "무관"
SELF, SELF_OR_HOME = "본인", ("세대주분기", "청년특공_분기")
WITH_PARENTS = "본인+부모"
FAMILY_CLASSES = ("한부모", "신생아")
SEOUL, PLACE_OF_NOTICE, ELSEWHERE = "서울", "모집지역", "기타"
LARGEST_HOUSEHOLD = 7

RULE = (
    "code string, age_min int, age_max int, age_exempt array<string>, marital string, marital_max_yr int, newborn_exempt boolean, "
    "required_class array<string>, homeless_scope string, income_pct int, income_pct_dual int, income_small_bonus boolean, income_scope string, "
    "asset_limit int, asset_scope string, car_limit int, region_limit string"
)


class Check(NamedTuple):
    ok: Column
    unsure: Column


def sure(ok: Column) -> Check:
    return Check(ok, F.lit(False))


def among(column: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def share(a: Column, b: Column) -> Column:
    """Whether two arrays have a value in common; null arrays have none."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def check_age() -> Check:
    asked = (F.col("age_min") > 0) | (F.col("age_max") < 999)
    return sure(~asked | share(F.col("age_exempt"), F.col("classes")) | F.col("age").between(F.col("age_min"), F.col("age_max")))


def check_marital() -> Check:
    """Any state, the single alone, or families; those also take the engaged, single parents and homes with a newborn."""
    limit = F.coalesce("marital_max_yr", F.lit(0))
    in_time = F.col("married_years") <= limit
    by_class = share(F.array(*map(F.lit, FAMILY_CLASSES)), F.col("classes"))
    engaged = F.col("marital_state") == ENGAGED
    family = (F.col("marital_state") == MARRIED) | engaged | by_class
    forgiven = engaged | (limit == 0) | (F.col("newborn_exempt") & F.col("has_newborn")) | by_class | in_time
    ok = (
        F.when(F.col("marital") == ANY, (limit == 0) | (F.col("marital_state") != MARRIED) | in_time)
        .when(F.col("marital") == SINGLE, F.col("marital_state") == SINGLE)
        .otherwise(family & (forgiven | F.col("newborn_exempt")))
    )
    # children of three to six years would count too, but nobody has asked for them
    return Check(ok, ~F.col("marital").isin(ANY, SINGLE) & family & ~forgiven & F.col("newborn_exempt"))


def check_class() -> Check:
    return sure((F.size("required_class") == 0) | share(F.col("required_class"), F.col("classes")))


def check_homeless() -> Check:
    return sure(F.when(F.col("homeless_scope") == SELF, F.col("homeless_self") | F.col("homeless")).otherwise(F.col("homeless")))


def split_scope(scope: str, own: Column, home: Column, own_limit: Column, home_limit: Column) -> Check:
    """What counts for oneself, for the home, or for either depending on who heads the home, which nobody has asked for."""
    self_ok, home_ok = own <= own_limit, home <= home_limit
    branch = among(scope, SELF_OR_HOME)
    ok = F.when(branch & (F.col("household") > 1), self_ok | home_ok).when(branch | (F.col(scope) == SELF), self_ok).otherwise(home_ok)
    return Check(ok, branch & (F.col("household") > 1) & (self_ok != home_ok))


def check_income() -> Check:
    """Against the limits that ``with_income_limits`` has put beside the pair."""
    found = split_scope("income_scope", F.col("income_self"), F.col("income_home"), F.col("limit_self"), F.col("limit_home"))
    asked = F.col("limit_self").isNotNull() & F.col("limit_home").isNotNull()
    ok = F.when(asked, found.ok).otherwise(F.lit(True))
    parents = (F.col("income_scope") == WITH_PARENTS) & ok
    return Check(ok, asked & F.coalesce(found.unsure | parents, F.lit(False)))


def check_asset() -> Check:
    limit = F.col("asset_limit")
    found = split_scope("asset_scope", F.col("asset_self"), F.col("asset_home"), limit, limit)
    return Check(limit.isNull() | found.ok, limit.isNotNull() & found.unsure)


def check_car() -> Check:
    return sure(F.col("car_limit").isNull() | (F.col("car") <= F.col("car_limit")))


def check_region() -> Check:
    seoul = F.coalesce(F.col("region_limit") == SEOUL, F.lit(False))
    unknown = F.coalesce(F.col("residence"), F.lit("")) == ""
    return Check(~seoul | unknown | (F.col("tier") == SEOUL), seoul & unknown)


CHECKS = (check_age, check_marital, check_class, check_homeless, check_income, check_asset, check_car, check_region)


def small_bonus(household: Column) -> Column:
    """Points that homes of one and two get on top."""
    return F.when(household <= 1, 20).when(household == 2, 10).otherwise(0)


def with_income_limits(pairs: DataFrame, standard: DataFrame) -> DataFrame:
    """``pairs`` with limit_home and limit_self: the income limits for the home's size, and for one.

    ``standard`` has household, pct and amount. A percentage that it does not state is taken of the size's base amount.
    """
    dual = F.col("dual") & (F.col("marital_state") != SINGLE) & F.coalesce(F.col("income_pct_dual") > 0, F.lit(False))
    base = F.when(dual, F.col("income_pct_dual")).otherwise(F.col("income_pct"))

    def bonus(household: Column) -> Column:
        return F.when(F.col("income_small_bonus"), small_bonus(household)).otherwise(0)

    table = small(standard).groupBy().agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("household").cast("int"), F.col("pct").cast("int")), F.col("amount").cast("double")))).alias("__known")
    )  # one row of a table whose size is checked

    def limit(household: Column, pct: Column) -> Column:
        size = F.least(F.greatest(household, F.lit(1)), F.lit(LARGEST_HOUSEHOLD)).cast("int")
        stated = F.try_element_at("__known", F.struct(size, pct.cast("int")))
        whole = F.try_element_at("__known", F.struct(size, F.lit(100)))
        return F.coalesce(stated, F.floor(whole * pct / 100 + 0.5).cast("double"))

    home, alone = F.col("household"), F.lit(1)
    return pairs.join(F.broadcast(table)).withColumn("limit_home", limit(home, base + bonus(home))).withColumn(
        "limit_self", limit(alone, base + bonus(alone))
    ).drop("__known")


def tier_of(residence: Column, tiers: list[tuple[str, str, str]]) -> Column:
    """The tier of a place from (name, kind, tier): its own, else that of the province it lies in."""
    own = [F.when(residence == name, F.lit(tier)) for name, _, tier in tiers]
    around = [F.when(residence.startswith(name), F.lit(tier)) for name, kind, tier in tiers if kind == "sido"]
    return F.coalesce(*own, *around, F.lit(ELSEWHERE))


def diagnose(pairs: DataFrame) -> tuple[Column, Column, Column]:
    """ok, unsure and the numbers of the failed checks (from 1) of pairs of profiles and rules with their income limits."""
    found = [c() for c in CHECKS]
    ok = [F.coalesce(c.ok, F.lit(False)) for c in found]
    failed = F.array_compact(F.array(*[F.when(~o, F.lit(i)) for i, o in enumerate(ok, 1)]))
    unsure = reduce(lambda a, b: a | b, [F.coalesce(c.unsure, F.lit(False)) for c in found])
    return reduce(lambda a, b: a & b, ok), unsure, failed


# Ranks and points of single kinds of notices ---------------------------------------------------------------------------


def birth_bonus(newborns: Column, older_minor: Column) -> Column:
    """Points on the income limit for children born of late: 10 for one, 20 for two, or one beside an older minor."""
    return F.when((newborns >= 2) | ((newborns == 1) & older_minor), 20).when(newborns == 1, 10).otherwise(0)


def rank_percentage(pct: Column, dual_pct: Column, bonus: Column, dual: Column) -> Column:
    """The percentage of a rank for a home: its own with the bonus, or that for two earners if it is higher."""
    return F.when(dual & dual_pct.isNotNull() & pct.isNotNull(), F.greatest(dual_pct, pct + bonus)).otherwise(pct + bonus)


#: Priority points of the happy-home classes: the most there are, and of each item its steps from high to low.
DEPOSIT_STEPS, AGE_STEPS = ((24, 3), (6, 1)), ((75, 3), (70, 2), (65, 1))
MOST_POINTS = {"대학생": 3, "청년": 6, "신혼부부": 6, "고령자": 9, "주거급여수급자": 6}


def steps(value: Column, table: tuple[tuple[int, int], ...], otherwise: int = 0) -> Column:
    out = F.when(F.lit(False), 0)
    for least, points in table:
        out = out.when(value >= least, points)
    return out.otherwise(otherwise)


def priority_points(kind: Column, seoul: Column, years: Column, deposits: Column, age: Column, special: Column) -> Column:
    """The points of a class of applicants; null for a class without points."""
    here = F.when(~seoul, 0).otherwise(steps(years, ((3, 3),), 1))
    district = F.when(~seoul, 0).otherwise(steps(years, ((5, 3),), 2))
    privileged = F.when(special, 3).otherwise(0)
    return (
        F.when(kind == "대학생", steps(years, ((3, 3),), 1))
        .when(kind.isin("청년", "신혼부부"), here + steps(deposits, DEPOSIT_STEPS))
        .when(kind == "고령자", steps(age, AGE_STEPS) + district + privileged)
        .when(kind == "주거급여수급자", district + privileged)
    )


def prior_lines(results: DataFrame, keys: list[str]) -> DataFrame:
    """By key the units and applicants of earlier results and their ratio to two places; lines without units do not count."""
    whole = results.filter("units > 0 AND applicants IS NOT NULL").groupBy(*keys).agg(F.sum("units").alias("units"), F.sum("applicants").alias("applicants"))
    return whole.withColumn("ratio", F.round(F.col("applicants") / F.col("units"), 2))
