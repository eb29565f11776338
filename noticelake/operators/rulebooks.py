"""Rule tables from workbook sheets whose cells are all text, and corrections laid over them.

A sheet is landed as rows of seq and cells, a map from its headers to texts. The headers and what a cell means are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "ID"
#: From these numbers on a limit means that there is none.
NO_PCT, NO_AMOUNT = 999, 999_999
#: What each column of a rule is read from, and how: text with a default, a number with a default, a limit, a list or a yes.
RULE_CELLS = (
    ("category", "카테고리", "text", None), ("name", "유형명", "text", None), ("age_min", "최소나이", "number", 0), ("age_max", "최대나이", "number", 999),
    ("age_exempt", "나이면제조건", "list", None), ("marital", "혼인조건", "text", "무관"), ("marital_max_yr", "혼인MAX년", "number", 0), ("newborn_exempt", "신생아혼인면제", "yes", None),
    ("required_class", "필수계층", "list", None), ("homeless_scope", "무주택요건", "text", "세대원"), ("income_scope", "소득기준방식", "text", "무관"),
    ("income_pct", "소득기준%", "limit", NO_PCT), ("asset_scope", "자산기준방식", "text", "무관"), ("asset_limit", "자산만원", "limit", NO_AMOUNT),
    ("car_limit", "자동차만원", "limit", NO_AMOUNT), ("region_limit", "지역제한", "text", "전국"), ("birth_bonus", "출산자녀가산", "yes", None), ("note", "비고", "text", None),
)
METHOD, PRIORITY, GENERAL = "선정방식", [f"우선{i}순위조건" for i in (1, 2, 3, 4)], [f"일반{i}순위조건" for i in (1, 2, 3)]


def cell(name: str, cells: str = "cells") -> Column:
    """The text of a cell without blanks around it; empty if it is not there."""
    return F.trim(F.coalesce(F.try_element_at(F.col(cells), F.lit(name)), F.lit("")))


def whole(text: Column) -> Column:
    """A number, cut to a whole one; null for what is none."""
    return F.nullif(text, F.lit("")).try_cast("double").cast("int")


def typed(text: Column, kind: str, more: object) -> Column:
    if kind == "text":
        return F.coalesce(F.nullif(text, F.lit("")), F.lit(more).cast("string"))
    if kind == "number":
        return F.coalesce(whole(text), F.lit(more))
    if kind == "limit":
        return F.when(whole(text) < more, whole(text))
    if kind == "yes":
        return F.upper(text) == "Y"
    return F.filter(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def supply_types(rules: DataFrame, scores: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """A row for each rule with a code: its typed columns, how it is selected, its ranks, and what else its score sheet says.

    ``rules`` and ``scores`` have seq and cells and are joined by code; of scores with one code the last counts. ``kinds`` maps a
    category, or else a name, to a housing type. Rows count in the order of the sheet, without those that have no code.
    """
    coded = rules.select("seq", "cells", cell(KEY).alias("code")).filter("code <> ''")
    extra = scores.select(cell(KEY).alias("code"), F.struct("seq", "cells").alias("s")).filter("code <> ''").groupBy("code").agg(F.max_by("s.cells", "s.seq").alias("score_cells"))
    joined = coded.join(extra, "code", "left")
    columns = [typed(cell(header), kind, more).alias(name) for name, header, kind, more in RULE_CELLS]
    own = {KEY, "카테고리", "유형명", METHOD, *PRIORITY, *GENERAL}
    nothing = F.create_map().cast("map<string,string>")
    rest = F.map_filter(F.coalesce("score_cells", nothing), lambda k, v: ~k.isin(*own) & (F.trim(v) != ""))

    def said(names: list[str]) -> Column:
        return F.filter(F.array(*[cell(n, "score_cells") for n in names]), lambda x: x != "")

    known = F.create_map(*[F.lit(x) for pair in (kinds or {}).items() for x in pair]) if kinds else nothing
    housing = F.coalesce(F.try_element_at(known, cell("카테고리")), F.try_element_at(known, cell("유형명")))
    return joined.select(
        "code", "seq", *columns, housing.alias("housing_type"), F.nullif(cell(METHOD, "score_cells"), F.lit("")).alias("ranking_method"),
        said(PRIORITY).alias("ranks"), said(GENERAL).alias("general_ranks"), F.transform_values(rest, lambda k, v: F.trim(v)).alias("score"),
    )


def corrected(rows: DataFrame, key: str, patches: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """``rows`` with defaults for columns that they lack, and over them what the patch of their key says.

    ``patches`` has the key and patch, a map from columns to texts, where null empties a column. Columns that a patch does not name
    stay. Laid on twice it is the same; of patches with one key the first by their text counts.
    """
    for name, value in (defaults or {}).items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    once = patches.groupBy(key).agg(F.min_by("patch", F.to_json("patch")).alias("__patch"))
    joined = rows.join(once, key, "left")
    kinds = dict(rows.dtypes)
    out = []
    for c in rows.columns:
        named = F.coalesce(F.map_contains_key("__patch", F.lit(c)), F.lit(False))
        text = F.try_element_at("__patch", F.lit(c))
        value = F.from_json(text, kinds[c]) if kinds[c].startswith("array") else text.try_cast(kinds[c])
        out.append(F.col(c) if c == key else F.when(named, value).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def income_standard(sheet: DataFrame, year: int) -> DataFrame:
    """year, household, pct and won of a sheet whose headers are percentages and whose first column, named 가구원수, is the size."""
    cells = sheet.select(cell("가구원수").alias("size"), F.explode("cells").alias("header", "won"))
    good = cells.filter(F.col("size").rlike("^[0-9]+$") & F.col("header").rlike("^[0-9]+%$") & (F.trim("won") != ""))
    return good.select(F.lit(year).alias("year"), F.col("size").cast("int").alias("household"), F.regexp_extract("header", "[0-9]+", 0).cast("int").alias("pct"), F.trim("won").try_cast("double").cast("long").alias("won"))
