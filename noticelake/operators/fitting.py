"""Whether and in which rank a profile fits a notice, by the notice's own tables: five kinds of notices, each with its rules as rows.

Profiles and rules are frames; a profile meets only the few rows of its own notice, and what it gets is one aggregate over them.
A limit that is not known rules nobody out. Words are fixed values of the domain.

Profiles have id and notice, and of the rest what a kind of notice looks at: household, income, income_self, assets, car, age, dual,
newborns, older_minor, deposits, years (of residence), gu, special, group, area, class, estate_gu, applicant, priority_class,
parents_homeless, disabled_self, disabled_family, homeless.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.operators.eligibility import birth_bonus, priority_points, rank_percentage, small_bonus, steps

LARGEST = 7
#: What rank rows ask of where one lives: in the estate's district, in one beside it, elsewhere in the city.
OWN_DISTRICT, NEXT_DISTRICT, OTHER_DISTRICT = "위치한 자치구 거주", "연접자치구 거주", "그 외 서울시 자치구 거주"
#: Places that are no district of the city.
BESIDE, REST_OF_PROVINCE, ELSEWHERE = "연접", "경기기타", "기타"
#: Classes of applicants by the first pattern that their name has.
CLASS_PATTERNS = (("대학생", "대학생"), ("청년", "청년"), ("신혼|한부모", "신혼부부"), ("고령자", "고령자"), ("주거급여", "주거급여수급자"))
YOUTH_AGE, OLD_AGE = (19, 39), 65
YOUTH_STEPS = ((24, 3), (12, 2), (6, 1))
PRIVATE_PCTS = (100, 110, 120)


def no(x: Column) -> Column:
    """Whether a condition is false, not just unknown."""
    return ~F.coalesce(x, F.lit(True))


def at_most(value: Column, limit: Column) -> Column:
    return value <= limit


def in_city(gu: Column) -> Column:
    return ~F.coalesce(gu, F.lit("")).isin("", BESIDE, REST_OF_PROVINCE, ELSEWHERE)


def bonus_of() -> Column:
    return birth_bonus(F.col("newborns"), F.col("older_minor"))


def class_key(name: Column) -> Column:
    return F.coalesce(*[F.when(name.rlike(p), F.lit(k)) for p, k in CLASS_PATTERNS], name)


def with_limit(rows: DataFrame, stated: DataFrame, seed: DataFrame, pct: Column, household: Column, name: str, bump: bool) -> DataFrame:
    """``rows`` with the income limit of a percentage and size of household, null if nothing says what it is.

    ``stated`` has notice, pct, household and won of verified tables, and per_person where a table goes on by a sum for each person
    more than its last column; ``seed`` has household and amount, the base of all percentages, rounded half up. ``bump``: homes of
    one and two get points on top of the base.
    """
    size = F.least(F.greatest(household, F.lit(1)), F.lit(LARGEST))
    known = stated.select("notice", F.col("pct").alias("__pct"), F.col("household").alias("__size"), F.col("won").alias("__won"))
    ends = stated.groupBy("notice", F.col("pct").alias("__pct")).agg(
        F.max(F.struct("household", "won")).alias("__end"), F.max("per_person").alias("__per")
    )
    base = seed.select(F.col("household").alias("__size"), F.col("amount").alias("__base"))
    joined = rows.withColumn("__pct", pct.cast("int")).withColumn("__size", size.cast("int"))
    joined = joined.join(known, ["notice", "__pct", "__size"], "left").join(ends, ["notice", "__pct"], "left").join(base, "__size", "left")
    beyond = F.when(F.col("__size") > F.col("__end.household"), F.col("__end.won") + F.col("__per") * (F.col("__size") - F.col("__end.household")))
    points = F.col("__pct") + (small_bonus(F.col("__size")) if bump else F.lit(0))
    limit = F.coalesce(F.col("__won"), beyond, F.floor(F.col("__base") * points / 100 + 0.5).cast("long"))
    return joined.withColumn(name, limit).drop("__pct", "__size", "__won", "__end", "__per", "__base")


def asset_column(columns: Column) -> Column:
    """Which column of a table of asset limits holds for a profile, from 0."""
    bonus = bonus_of()
    wide = F.when(F.col("newborns") >= 2, 3).when((F.col("newborns") == 1) & F.col("older_minor"), 2).when(F.col("newborns") == 1, 1).otherwise(0)
    return F.when(columns >= 4, wide).otherwise(F.when(bonus == 20, 2).when(bonus == 10, 1).otherwise(0))


def assets_pass(profiles: DataFrame, assets: DataFrame, applies: Column | None = None) -> DataFrame:
    """id and assets_ok: whether assets and cars keep the limits of the notice; null if it states none.

    ``assets`` has notice, label, car (whether it is about cars), columns and limits, an array.
    """
    pairs = profiles.join(assets, "notice")
    pairs = pairs if applies is None else pairs.filter(applies)
    limit = F.coalesce(F.get("limits", asset_column(F.col("columns"))), F.get("limits", F.lit(0)))
    mine = F.when(F.col("is_car"), F.col("car")).otherwise(F.col("assets"))
    return pairs.groupBy("id").agg(F.min(mine <= limit).alias("assets_ok"))


def long_lease_fit(profiles: DataFrame, ranks: DataFrame, assets: DataFrame, stated: DataFrame, seed: DataFrame) -> DataFrame:
    """id, ok, rank, pct and won of long leases: the first rank row, from the top, whose income, deposits and place fit.

    ``ranks`` has notice, table_no, group, seq, rank, area, income_pct, dual_pct and requirement. The profile's group names its table, else
    the first table counts; without an area all rows do. Rows without a rank count only where no row has one. Without rows nothing
    is said.
    """
    groups = ranks.groupBy("notice", "group").agg(F.min("table_no").alias("own"))
    firsts = ranks.groupBy("notice").agg(F.min("table_no").alias("first"))
    placed = profiles.join(groups, ["notice", "group"], "left").join(firsts, "notice", "left").withColumn("table_no", F.coalesce("own", "first")).drop("own", "first", "group")
    table = ranks.drop("group").withColumnRenamed("area", "row_area")
    pairs = placed.join(table, ["notice", "table_no"]).filter(F.col("area").isNull() | (F.col("area") == F.col("row_area")))
    pct = rank_percentage(F.col("income_pct"), F.col("dual_pct"), bonus_of(), F.col("dual"))
    pairs = with_limit(pairs.withColumn("own_pct", pct), stated, seed, F.col("own_pct"), F.col("household"), "limit", False)
    asks = F.coalesce("requirement", F.lit(""))
    need = F.nullif(F.regexp_extract(asks, r"(\d+)\s*회\s*이상", 1), F.lit("")).cast("int")
    place = (
        F.when(asks.contains(OWN_DISTRICT), F.col("estate_gu").isNull() | F.coalesce(F.col("estate_gu") == F.col("gu"), F.lit(False)))
        .when(asks.contains(NEXT_DISTRICT), F.col("estate_gu").isNull())
        .when(asks.contains(OTHER_DISTRICT), in_city(F.col("gu"))).otherwise(F.lit(True))
    )
    fits = ~no(F.col("income") <= F.col("limit")) & ~no(F.col("deposits") >= need) & place
    found = F.struct("rank", "seq", F.col("own_pct").alias("pct"), F.col("limit").alias("won"))
    loose = F.struct(F.lit(None).cast("int").alias("rank"), "seq", F.col("own_pct").alias("pct"), F.col("limit").alias("won"))
    ranked = F.col("rank").isNotNull()
    best = pairs.groupBy("id").agg(F.max(ranked).alias("any"), F.min(F.when(ranked & fits, found)).alias("top"), F.min(F.when(~ranked & fits, loose)).alias("other"))
    best = best.select("id", F.when(F.col("any"), F.col("top")).otherwise(F.col("other")).alias("hit"), F.lit(True).alias("judged"))
    out = profiles.select("id").join(best, "id", "left").join(assets_pass(profiles, assets), "id", "left")
    ok = F.when(F.col("judged"), F.col("hit").isNotNull() & ~no(F.col("assets_ok")))
    won = F.when(F.col("hit.pct").isNotNull(), F.col("hit.won"))
    return out.select("id", ok.alias("ok"), F.col("hit.rank").alias("rank"), F.col("hit.pct").alias("pct"), won.alias("won"))


def happy_home_fit(profiles: DataFrame, classes: DataFrame, assets: DataFrame, stated: DataFrame, seed: DataFrame) -> DataFrame:
    """id, key, ok, rank, priority, points, pct and won of happy homes.

    ``classes`` has notice, block_no, name and ranked (whether the general supply has ranks). The profile's class names its block,
    else the first counts. Income is that of the class, 120 for couples of two earners, with points for children; who gets housing
    aid is not asked for income or assets. Applicants of old age must be old; the young may be of any age, as beginners at work are.
    """
    named = classes.groupBy("notice", "name").agg(F.min("block_no").alias("own"))
    firsts = classes.groupBy("notice").agg(F.min("block_no").alias("first"))
    asked = profiles.withColumn("name", F.col("class")).join(named, ["notice", "name"], "left").join(firsts, "notice", "left")
    picked = asked.withColumn("block_no", F.coalesce("own", "first")).drop("own", "first", "name")
    rows = picked.join(classes.select("notice", "block_no", "name", "ranked"), ["notice", "block_no"], "left").withColumn("key", class_key(F.col("name")))
    pct = F.when((F.col("key") == "신혼부부") & F.col("dual"), 120).otherwise(100) + bonus_of()
    rows = with_limit(rows.withColumn("pct", F.when(F.col("key").isNotNull(), pct)), stated, seed, F.col("pct"), F.col("household"), "won", True)
    aided = F.col("key") == "주거급여수급자"
    kinds = F.when(F.col("is_car"), "자동차").otherwise("총자산")
    first_rows = assets.withColumn("is_kind", F.col("label").contains(kinds)).filter("is_kind").drop("is_kind")
    about = F.col("label").contains(F.col("key")) & ~aided
    # of several rows about a class the first counts
    pairs = rows.select("id", "notice", "key", "newborns", "older_minor", "assets", "car").join(first_rows, "notice").filter(about)
    limit = F.coalesce(F.get("limits", asset_column(F.col("columns"))), F.get("limits", F.lit(0)))
    mine = F.when(F.col("is_car"), F.col("car")).otherwise(F.col("assets"))
    firsts = pairs.groupBy("id", "is_car").agg(F.min_by(mine <= limit, "seq").alias("keeps"))
    kept = firsts.groupBy("id").agg(F.min("keeps").alias("assets_ok"))
    joined = rows.join(kept, "id", "left")
    old = (F.col("key") != "고령자") | (F.col("age") >= OLD_AGE)
    ok = old & (aided | (~no(F.col("income") <= F.col("won")) & ~no(F.col("assets_ok"))))
    city = in_city(F.col("gu"))
    rank = F.when(F.col("ranked"), F.when(city | (F.col("gu") == BESIDE), 1).when(F.col("gu") == REST_OF_PROVINCE, 2).otherwise(3))
    points = F.when(city, priority_points(F.col("key"), city, F.col("years"), F.col("deposits"), F.col("age"), F.col("special")))
    judged = F.col("key").isNotNull()
    return joined.select("id", F.coalesce("key", F.lit("")).alias("key"), F.when(judged, ok).alias("ok"), F.when(judged, rank).alias("rank"), F.when(judged & city, 2).alias("priority"), points.cast("int").alias("points"), "pct", F.when(judged, F.col("won")).alias("won"))


def first_table(ranks: DataFrame) -> DataFrame:
    """The rows of the first table of each notice."""
    firsts = ranks.groupBy("notice").agg(F.min("table_no").alias("table_no"))
    return ranks.join(firsts, ["notice", "table_no"])


def purchase_lease_fit(profiles: DataFrame, ranks: DataFrame, stated: DataFrame, seed: DataFrame) -> DataFrame:
    """id, ok, rank, pct and won of purchase leases: the first rank, in order, that asks for no income or whose limit holds."""
    pairs = profiles.join(first_table(ranks), "notice")
    pairs = with_limit(pairs, stated, seed, F.col("income_pct"), F.col("household"), "limit", True)
    fits = F.col("income_pct").isNull() | ~no(F.col("income") <= F.col("limit"))
    order = F.struct(F.coalesce("rank", F.lit(9)).alias("place"), "seq", "rank", F.col("income_pct").alias("pct"), F.col("limit").alias("won"))
    best = pairs.groupBy("id").agg(F.min(F.when(fits, order)).alias("hit"), F.lit(True).alias("judged"))
    found = profiles.select("id").join(best, "id", "left")
    won = F.when(F.col("hit.pct").isNotNull(), F.col("hit.won"))
    return found.select("id", F.when(F.col("judged"), F.col("hit").isNotNull()).alias("ok"), F.col("hit.rank").alias("rank"), F.col("hit.pct").alias("pct"), won.alias("won"))


def youth_lease_fit(profiles: DataFrame, ranks: DataFrame, stated: DataFrame, seed: DataFrame) -> DataFrame:
    """id, ok, rank, points, pct and won of purchase leases for the young.

    Who is of a first class has rank one without being asked for more. Rank two looks at the income and assets of oneself and
    one's parents, rank three, where the notice has it, at one's own against the limit of a home of one. Points add up within a rank.
    """
    rows = first_table(ranks).filter("rank IN (2, 3)").groupBy("notice", "rank").agg(F.min_by(F.struct("income_pct", "asset", "car_limit"), "seq").alias("r"))
    second = rows.filter("rank = 2").select("notice", F.col("r").alias("r2"))
    third = rows.filter("rank = 3").select("notice", F.col("r").alias("r3"))
    known = ranks.select("notice").distinct().withColumn("judged", F.lit(True))
    asked = profiles.join(known, "notice", "left").join(second, "notice", "left").join(third, "notice", "left")
    asked = asked.withColumn("pct2", F.coalesce("r2.income_pct", F.lit(100))).withColumn("pct3", F.coalesce("r3.income_pct", F.lit(100)))
    asked = with_limit(asked, stated, seed, F.col("pct2"), F.col("household"), "won2", True)
    asked = with_limit(asked, stated, seed, F.col("pct3"), F.lit(1), "won3", True)
    asked = with_limit(asked, stated, seed, F.lit(50), F.col("household"), "half2", True)
    asked = with_limit(asked, stated, seed, F.lit(50), F.lit(1), "half3", True)

    def keeps(r: str) -> Column:
        return ~no(F.col("assets") <= F.col(f"{r}.asset")) & ~no(F.col("car") <= F.col(f"{r}.car_limit"))

    privileged = F.coalesce("priority_class", F.lit("")) != ""
    fits2 = ~no(F.col("income") <= F.col("won2")) & keeps("r2")
    fits3 = F.col("r3").isNotNull() & ~no(F.col("income_self") <= F.col("won3")) & keeps("r3")
    rank = F.when(privileged, 1).when(fits2, 2).when(fits3, 3)
    asked = asked.withColumn("rank", F.when(F.col("judged"), rank))
    low = F.when(F.col("rank") == 2, F.col("income") <= F.col("half2")).when(F.col("rank") == 3, F.col("income_self") <= F.col("half3"))

    def points(holds: Column, n: int) -> Column:
        return F.when(F.coalesce(holds, F.lit(False)), n).otherwise(0)

    first = F.col("rank") == 1
    total = (
        points(first & F.col("priority_class").contains("수급자"), 3) + points(first & F.col("priority_class").contains("한부모"), 3)
        + points(F.col("parents_homeless"), 2) + points(F.col("disabled_self"), 2) + points(F.col("disabled_family"), 1) + points(low, 3)
        + steps(F.col("deposits"), YOUTH_STEPS)
    )
    of_age = ~F.coalesce("applicant", F.lit("")).rlike("청년|이공계") | F.col("age").between(*YOUTH_AGE)
    has = F.col("rank").isNotNull()
    pct = F.when(F.col("rank") == 2, F.col("pct2")).when(F.col("rank") == 3, F.col("pct3"))
    won = F.when(F.col("rank") == 2, F.col("won2")).when(F.col("rank") == 3, F.col("won3"))
    return asked.select("id", F.when(F.col("judged"), has & of_age).alias("ok"), "rank", F.when(has, total).alias("points"), pct.alias("pct"), won.alias("won"))


def private_lease_fit(profiles: DataFrame, limits: DataFrame, income: DataFrame) -> DataFrame:
    """id, common, special, general, rank, pct and region of private leases, which have a special and a general track.

    ``limits`` has class, asset and car_limit, a row for each class; ``income`` household, pct and won. Age, home and car hold for both tracks; the
    special one has ranks by income and a limit of assets, the general one asks for neither. The region's rank tells only between equal
    incomes; without a district on either side there is none.
    """
    size = F.least(F.greatest(F.col("household"), F.lit(1)), F.lit(LARGEST)).cast("int")
    table = income.filter(F.col("pct").isin(*PRIVATE_PCTS)).groupBy(F.col("household").alias("__size")).agg(
        F.map_from_entries(F.collect_list(F.struct("pct", "won"))).alias("__won")  # three at most
    )
    rows = profiles.withColumn("__size", size).join(table, "__size", "left").join(limits, "class", "left")
    common = F.col("age").between(*YOUTH_AGE) & F.col("homeless") & ~no(F.col("car") <= F.col("car_limit"))
    under = [F.col("income") <= F.try_element_at("__won", F.lit(p)) for p in PRIVATE_PCTS]
    place = F.coalesce(*[F.when(u, k) for k, u in enumerate(under, 1)])
    special = common & place.isNotNull() & ~no(F.col("assets") <= F.col("asset"))
    mine, there = F.coalesce("gu", F.lit("")), F.coalesce("estate_gu", F.lit(""))
    region = F.when((mine != "") & (there != ""), F.when(mine == there, 1).when(mine != ELSEWHERE, 2).otherwise(3))
    pct = F.coalesce(*[F.when(u, p) for p, u in zip(PRIVATE_PCTS, under, strict=True)])
    return rows.select("id", common.alias("common"), special.alias("special"), common.alias("general"), F.when(special, place).alias("rank"), pct.alias("pct"), region.alias("region"))


def private_picks(supply: DataFrame, verdicts: DataFrame) -> DataFrame:
    """id, line, option and can: the supply lines a profile may look at, and whether it can have them.

    ``supply`` has notice, line, tenant_class and income_option; ``verdicts`` id, notice, class, special and general. A line
    without a known track is open to who may have the general one; one without a known class is for all.
    """
    words = F.coalesce("tenant_class", F.lit(""))
    anyone = (words == "") | (words == "전체") | ~words.rlike("청년|대학생|1인|신혼|부부|전체")
    mine = F.when(F.col("class") == "청년", words.rlike("청년|대학생|1인")).otherwise(words.rlike("신혼|부부"))
    option = F.when(F.col("income_option").contains("특별"), "special").when(F.col("income_option").contains("일반"), "general")
    pairs = verdicts.join(supply, "notice").filter(anyone | mine).withColumn("option", option)
    can = F.when(F.col("option") == "special", F.col("special")).otherwise(F.col("general"))
    return pairs.select("id", "line", "option", can.alias("can"))


def latest_posts(results: DataFrame, posts: DataFrame) -> DataFrame:
    """The rows of the latest post of each notice and kind whose table could be read; earlier ones would count twice."""
    last = posts.filter("row_count > 0").groupBy("notice", "kind").agg(F.max_by("post", F.struct("posted_at", "post")).alias("post"))
    return results.join(last, ["notice", "kind", "post"], "left_semi")


def prior_for_estate(results: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """id, mine_units, mine_applicants, mine_ratio and the same of all, of earlier results for a profile's estate.

    ``results`` has notice, ``key`` (an estate's name as it is compared), bracket, tenant_class, units and applicants; ``asked`` id, notice, ``key``,
    kind, class, rank and priority. Happy homes look at the applicant's class alone, at the bracket that the profile is in, and say
    nothing where the class has no rows; other kinds at the bracket of the rank. Subtotals are what all applied for. Lines without units
    or applicants do not count. Profiles without any are absent.

    Results are summed up by what is compared, and each kind of profile is asked once, so no profile meets single rows.
    """
    compared = ["kind", "class", "rank", "priority"]
    counted = results.filter("units > 0 AND applicants IS NOT NULL").groupBy("notice", key, "bracket", "tenant_class").agg(F.sum("units").alias("units"), F.sum("applicants").alias("applicants"))
    known = asked.dropna(subset=["notice", key])
    pairs = known.select("notice", key, *compared).distinct().join(counted, ["notice", key])
    happy = (F.col("kind") == "happy") & F.col("class").isNotNull()
    of_class = F.coalesce(class_key(F.col("tenant_class")) == class_key(F.col("class")), F.lit(False)) & F.col("tenant_class").isNotNull()
    bracket = F.regexp_replace("bracket", r"\s", "")
    subtotal = F.col("bracket") == "소계"
    mine_happy = F.col("bracket") == F.when(F.col("priority"), "우선").otherwise("일반")
    mine_ranked = F.coalesce(bracket.endswith(F.concat(F.col("rank").cast("string"), F.lit("순위"))), F.lit(False)) & ~subtotal & (F.col("kind") != "happy")
    kept = pairs.filter(~happy | of_class)
    mine = F.when(happy, mine_happy).otherwise(mine_ranked)

    def sums(which: Column, name: str) -> list[Column]:
        return [F.sum(F.when(which, F.col(c))).alias(f"{name}_{c}") for c in ("units", "applicants")]

    found = kept.groupBy("notice", key, *compared).agg(*sums(mine, "mine"), *sums(subtotal, "all")).filter("mine_units IS NOT NULL OR all_units IS NOT NULL")
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ["notice", key, *compared]])
    out = known.alias("a").join(found.alias("f"), same).groupBy("a.id").agg(*[F.sum(f"f.{w}_{c}").alias(f"{w}_{c}") for w in ("mine", "all") for c in ("units", "applicants")])
    ratios = [(F.floor(F.col(f"{n}_applicants") / F.col(f"{n}_units") * 10 + 0.5) / 10).alias(f"{n}_ratio") for n in ("mine", "all")]
    return out.select("*", *ratios)
