"""One profile for several forms: what each form takes from it, and what it gives back.

Forms know a place in different ways: by its name (region), or by the city's district or a word for what lies around it (gu). What one
form cannot say about the other's place stays as it was. Words are fixed values of the domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.operators.fitting import BESIDE, ELSEWHERE, REST_OF_PROVINCE

CITY, OUTSIDE = "서울", "그 외 지역"
SINGLE, YOUNG, COUPLE = "미혼", "청년", "신혼부부"


def with_gu(rows: DataFrame, tiers: DataFrame, region: str = "region", name: str = "gu_of") -> DataFrame:
    """``rows`` with the district that a region is, a word for what lies beside the city, or for elsewhere; empty stays empty."""
    known = tiers.groupBy(F.col("name").alias("__name")).agg(F.min("tier").alias("__tier"))
    joined = rows.join(known, F.col(region) == F.col("__name"), "left")
    asked = F.coalesce(F.col(region), F.lit(""))
    gu = F.when(asked == "", "").when(F.col("__tier") == CITY, asked).when(F.col("__tier") == BESIDE, BESIDE).otherwise(ELSEWHERE)
    return joined.withColumn(name, gu).drop("__name", "__tier")


def with_region(rows: DataFrame, tiers: DataFrame, gu: str = "gu", name: str = "region_of") -> DataFrame:
    """``rows`` with the region of a district; null where the word does not say which it is, empty stays empty."""
    districts = tiers.filter((F.col("tier") == CITY) & (F.col("kind") == "sigungu")).select(F.col("name").alias("__name")).distinct()
    joined = rows.join(districts, F.col(gu) == F.col("__name"), "left")
    asked = F.coalesce(F.col(gu), F.lit(""))
    region = F.when(asked == "", "").when(F.col("__name").isNotNull(), asked).when(asked.isin(ELSEWHERE, REST_OF_PROVINCE), OUTSIDE)
    return joined.withColumn(name, region).drop("__name")


def reconciled(profiles: DataFrame, tiers: DataFrame) -> DataFrame:
    """``profiles`` with region and gu filled from each other where one alone is known, and whether that changed anything."""
    both = with_region(with_gu(profiles, tiers), tiers)
    region, gu = (F.coalesce(F.col(c), F.lit("")) for c in ("region", "gu"))
    from_region, from_gu = (region != "") & (gu == ""), (gu != "") & (region == "") & F.col("region_of").isNotNull()
    filled = both.withColumn("changed", from_region | from_gu)
    return filled.withColumn("gu", F.when(from_region, F.col("gu_of")).otherwise(F.col("gu"))).withColumn(
        "region", F.when(from_gu, F.col("region_of")).otherwise(F.col("region"))
    ).drop("gu_of", "region_of")


def class_of(classes: Column, marital: Column) -> Column:
    """The class of a private lease: one that is named, else by the state of marriage."""
    named = F.coalesce(*[F.when(F.array_contains(classes, F.lit(c)), F.lit(c)) for c in (YOUNG, COUPLE)])
    return F.coalesce(named, F.when(marital == SINGLE, YOUNG).otherwise(COUPLE))


def to_private(profiles: DataFrame) -> DataFrame:
    """What the form of private leases takes: a couple is of two at least, and outside the city all is elsewhere."""
    cls = class_of(F.col("classes"), F.col("marital"))
    gu = F.coalesce("gu", F.lit(""))
    return profiles.select(
        "id", cls.alias("class"), "age", F.when((cls == COUPLE) & (F.col("household") < 2), 2).otherwise(F.col("household")).alias("household"),
        F.col("income_home").alias("income"), F.col("asset_home").alias("assets"), "car", "homeless",
        F.when(gu.isin(BESIDE, REST_OF_PROVINCE), ELSEWHERE).otherwise(gu).alias("gu"),
    )


def from_private(profiles: DataFrame, filled: DataFrame, tiers: DataFrame) -> DataFrame:
    """``profiles`` with what the form of private leases was filled with, by id.

    One tick stands for being without a home oneself and as a household. The form's class replaces the classes that it knows, others
    stay. Elsewhere does not overwrite a word that says more. Profiles that the form was not filled for stay as they are.
    """
    given = with_region(filled, tiers).select("id", F.struct(*[c for c in filled.columns if c != "id"], "region_of").alias("f"))
    joined = profiles.join(given, "id", "left")
    has, f = F.col("f").isNotNull(), F.col("f")
    vague = (f["gu"] == ELSEWHERE) & F.coalesce(F.col("gu"), F.lit("")).isin(BESIDE, REST_OF_PROVINCE)
    classes = F.array_distinct(F.concat(F.filter("classes", lambda c: ~c.isin(YOUNG, COUPLE)), F.array(f["class"])))
    new = {
        "age": f["age"], "household": f["household"], "income_home": f["income"], "asset_home": f["assets"], "car": f["car"], "homeless": f["homeless"],
        "homeless_self": f["homeless"], "gu": F.when(vague, F.col("gu")).otherwise(f["gu"]), "region": F.coalesce(f["region_of"], F.col("region")), "classes": classes,
    }
    return joined.select(*[F.when(has, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in profiles.columns])
