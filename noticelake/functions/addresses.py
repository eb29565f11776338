"""Road addresses as Column expressions: province names, and the parts that the reference index is keyed by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full province names and their short forms.
PROVINCES = {
    "서울특별시": ("서울", "서울시"), "부산광역시": ("부산", "부산시"), "대구광역시": ("대구", "대구시"), "인천광역시": ("인천", "인천시"),
    "광주광역시": ("광주", "광주시"), "대전광역시": ("대전", "대전시"), "울산광역시": ("울산", "울산시"), "세종특별자치시": ("세종", "세종시"),
    "경기도": ("경기",), "강원특별자치도": ("강원", "강원도"), "충청북도": ("충북",), "충청남도": ("충남",), "전북특별자치도": ("전북", "전라북도"),
    "전라남도": ("전남",), "경상북도": ("경북",), "경상남도": ("경남",), "제주특별자치도": ("제주", "제주도"),
}
ALIASES = {short: full for full, shorts in PROVINCES.items() for short in (full, *shorts)}
ROAD = r"([가-힣A-Za-z0-9·.]*[가-힣](?:대로|로|길)(?:\s?\d+(?:번)?(?:가|나|다)?길)?)\s*(지하)?\s*(\d+)(?:\s*-\s*(\d+))?(?![0-9]*(?:번|가)?길)"


def province(name: Column) -> Column:
    """The full name of a province; unknown names are null."""
    pairs = [F.lit(x) for item in ALIASES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.trim(name))


def road_address(address: Column, given: Column | None = None) -> Column:
    """struct<sido, sigungu, road_name, underground, main_no, sub_no>; null without a road and a number.

    The province is the first word if it is one, else the one given; districts are the words that end in
    시, 군 or 구 before the road. A number glued to the road counts; without a sub number it is 0.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(address, r"\([^)]*\)", " "), r"[\s,]+", " "))
    head = F.regexp_extract(text, "^(.*?)" + ROAD, 1)
    words = F.filter(F.split(F.trim(head), " "), lambda w: w != "")
    first = province(F.try_element_at(words, F.lit(1)))
    rest = F.when(first.isNotNull(), F.slice(words, 2, 10)).otherwise(words)
    districts = F.filter(rest, lambda w: w.rlike("[시군구]$"))
    part = lambda i: F.nullif(F.regexp_extract(text, ROAD, i), F.lit(""))
    return F.when(
        part(1).isNotNull(),
        F.struct(
            F.coalesce(first, province(given) if given is not None else F.lit(None).cast("string")).alias("sido"),
            F.nullif(F.array_join(districts, " "), F.lit("")).alias("sigungu"),
            F.regexp_replace(part(1), r"\s", "").alias("road_name"),
            part(2).isNotNull().alias("underground"),
            part(3).cast("int").alias("main_no"),
            F.coalesce(part(4).cast("int"), F.lit(0)).alias("sub_no"),
        ),
    )
