"""Money as Column expressions; rounding is spelt out, since engines differ in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Yearly rates in percent for turning rent into deposit and back.
RATE_UP, RATE_DOWN = 6.0, 2.5


def half_up(x: Column) -> Column:
    """floor(x + 0.5) as a whole number."""
    return F.floor(x + F.lit(0.5)).cast("long")


def amount(text: Column, zero_is_null: bool = True) -> Column:
    """A whole amount; what is no number is null, and 0 too if asked for."""
    number = text.try_cast("long") if hasattr(text, "try_cast") else text.cast("long")
    return F.nullif(number, F.lit(0).cast("long")) if zero_is_null else number


def converted_rent(deposit: Column, rent: Column, new_deposit: Column) -> Column:
    """The rent after the deposit changes: more deposit saves at one rate, less costs at the other."""
    delta = half_up(new_deposit - deposit)
    rate = F.when(delta >= 0, F.lit(RATE_UP)).otherwise(F.lit(RATE_DOWN))
    monthly = half_up(F.abs(delta) * rate / 1200)
    changed = F.when(delta >= 0, rent - monthly).otherwise(rent + monthly)
    return F.greatest(F.lit(0).cast("long"), (F.floor(changed / 100) * 100).cast("long"))


def conversion_range(deposit: Column, rent: Column) -> tuple[Column, Column]:
    """The lowest and highest deposit if half of either may be converted."""
    return half_up(deposit * 0.5), deposit + half_up(rent * 0.5 * 1200 / RATE_UP)


def annuity(principal: Column, yearly: float, months: int) -> Column:
    """The equal monthly payment of a loan."""
    r = yearly / 1200
    return principal * r * (1 + r) ** months / ((1 + r) ** months - 1) if r else principal / months


def bullet_interest(principal: Column, yearly: float) -> Column:
    """The monthly interest of a loan that is paid back at its end."""
    return principal * yearly / 1200


def equal_principal_first(principal: Column, yearly: float, months: int) -> Column:
    """The first payment of a loan paid back in equal parts."""
    return principal / months + principal * yearly / 1200


def in_words(won: Column) -> Column:
    """An amount in hundred millions and ten thousands."""
    big, rest = F.floor(won / 100_000_000), F.floor((won % 100_000_000) / 10_000)
    return F.when(won.isNull(), "-").otherwise(
        F.concat_ws(
            " ",
            F.when(big > 0, F.concat(big.cast("string"), F.lit("억"))),
            F.when((rest > 0) | (big == 0), F.concat(rest.cast("string"), F.lit("만"))),
        )
    )


def scaled(value: Column, low: int, high: int, factors: tuple[int, ...] = (1, 1000, 10_000)) -> Column:
    """The value in won if exactly one of the factors puts it in the plausible range."""
    fits = F.filter(F.array(*[value * f for f in factors]), lambda x: (x >= low) & (x <= high))
    return F.when(F.size(fits) == 1, fits[0])


def common_area(shared: Column, other: Column) -> Column:
    """What a home shares with others: both parts to two places; a part that is not stated counts as nothing, without both it is null."""
    parts = [F.coalesce(p.cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")) for p in (shared, other)]
    return F.when(shared.isNotNull() | other.isNotNull(), (F.floor((parts[0] + parts[1]) * 100 + F.lit("0.5").cast("decimal(2,1)")) / 100).cast("double"))


def price_rows(deposit: Column, rent: Column, most_deposit: Column, most_rent: Column, down: Column, interim: Column, balance: Column) -> Column:
    """The rows of a table of prices as an array of (row, deposit, rent): the base, how it is paid, and the most.

    Payments are those stated, where 0 is not stated. Where none is and there is no rent to be paid, a tenth is taken to be due
    at once and nine tenths at the end. The most is shown only if it differs.
    """

    def row(name: str, d: Column, r: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("row"), d.cast("long").alias("deposit"), (F.lit(None) if r is None else r).cast("long").alias("rent"))

    stated = {"down": down, "interim": interim, "balance": balance}
    any_stated = F.greatest(*[F.coalesce(c, F.lit(0)) for c in stated.values()]) > 0
    guessed = ~any_stated & rent.isNull() & deposit.isNotNull()
    differs = F.coalesce(most_deposit.isNotNull() & ~most_deposit.eqNullSafe(deposit), F.lit(False)) | (most_rent.isNotNull() & ~most_rent.eqNullSafe(rent))
    rows = [
        row("base", deposit, rent), *[F.when(c > 0, row(n, c)) for n, c in stated.items()],
        F.when(guessed, row("down-est", half_up(deposit * 0.1))), F.when(guessed, row("balance-est", half_up(deposit * 0.9))),
        F.when(differs, row("max", F.coalesce(most_deposit, deposit), F.coalesce(most_rent, rent))),
    ]
    return F.array_compact(F.array(*rows))


#: Amounts that there may be, and below which a bare number is one of ten thousands.
DEPOSITS, RENTS = (1_000_000, 1_500_000_000), (10_000, 20_000_000)
SMALL_DEPOSIT, SMALL_RENT = 100_000, 10_000


def in_won(value: Column, column_scale: Column, table_scale: Column, rent: bool = False) -> Column:
    """An amount in won: by the unit of its column, else that of its table, else by its size.

    If that is no amount that there may be, the unit is taken to be wrong, and the one factor that gives such an amount is used; with
    several or none the amount is null.
    """
    least, most = RENTS if rent else DEPOSITS
    guessed = F.when(value < (SMALL_RENT if rent else SMALL_DEPOSIT), 10_000).otherwise(1)
    exact = value.cast("decimal(28,4)")
    stated = F.floor(exact * F.coalesce(F.nullif(column_scale, F.lit(0)), F.nullif(table_scale, F.lit(0)), guessed).cast("decimal(9,0)")).cast("long")
    return F.when(value.isNull(), F.lit(None).cast("long")).when(stated.between(least, most), stated).otherwise(F.floor(scaled(exact, least, most)).cast("long"))


def area_band(label: Column) -> Column:
    """(low, high) of a label such as over 60 and up to 85 square metres; high is null if there is none, all is null for other labels."""
    marks = F.regexp_extract_all(label, F.lit(r"(\d+(?:\.\d+)?)\s*㎡\s*(?:이하|초과|미만|이상)"), F.lit(0))
    upper = F.filter(marks, lambda m: m.rlike("이하|미만"))
    lower = F.filter(marks, lambda m: m.rlike("초과|이상"))

    def last(found: Column) -> Column:
        return F.regexp_extract(F.try_element_at(found, F.lit(-1)), r"\d+(?:\.\d+)?", 0).cast("double")

    return F.when(F.size(marks) > 0, F.struct(F.coalesce(last(lower), F.lit(0.0)).alias("low"), last(upper).alias("high")))
