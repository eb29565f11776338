"""Text functions as Column expressions. The name keys differ on purpose and are not to be unified."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the reference's browsers see it, beyond Java's \s.
BLANKS = "[\\s\\u00A0\\u3000]+"


def search_norm(text: Column) -> Column:
    """Lower case without white space; null becomes empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, ""))


def search_key(*fields: Column) -> Column:
    """Normalised fields joined by a bar; null fields count as empty."""
    return F.concat_ws("|", *[search_norm(f) for f in fields])


def like_escape(term: str) -> str:
    """A term whose LIKE wildcards stand for themselves."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search_term(raw: str, least: int = 2) -> str | None:
    """The normalised term, or none if it is too short to search for."""
    norm = "".join(raw.lower().replace("　", "").replace(" ", "").split())
    return norm if len(norm) >= least else None


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def fingerprint(agency: Column, title: Column, day: Column, number: Column, amends: Column) -> Column:
    """sha256 of the fields joined by bars; null fields and number 0 are empty."""
    parts = [agency, title, F.date_format(day, "yyyy-MM-dd"), F.nullif(number, F.lit(0)).cast("string"), amends]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def shorten_if_long(text: Column, pattern: str, least: int = 10) -> Column:
    """Removes a pattern only if enough of the text is left."""
    cut = F.trim(F.regexp_replace(text, pattern, ""))
    return F.when(F.length(cut) >= least, cut).otherwise(text)


def name_key_a(name: Column) -> Column:
    """Without (...) groups, separators, dashes and square brackets, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "\\([^)]*\\)", ""), "[\\]\\[_.,·・\\s-]", ""))


def name_key_c(name: Column, noise: list[str]) -> Column:
    """Without blanks and a list of noise words, taken out one after the other."""
    out = F.regexp_replace(name, BLANKS, "")
    for word in noise:
        out = F.replace(out, F.lit(word), F.lit(""))
    return out


def name_key_d(name: Column) -> Column:
    """Without blanks, commas, dots and brackets."""
    return F.regexp_replace(name, "[\\s,.()\\[\\]]", "")


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule whose pattern is found."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(label)) for p, label in rules])


def tags(text: Column, rules: list[tuple[str, str, str | None]]) -> Column:
    """The labels, in the order of the rules, whose pattern is found and whose exclusion is not."""
    hits = [
        F.when(text.rlike(p) & (~text.rlike(but) if but else F.lit(True)), F.lit(label)) for label, p, but in rules
    ]
    return F.array_compact(F.array(*hits))


def slug(*parts: Column) -> Column:
    """Parts joined by dashes, in lower case, with runs of other characters as one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("-", *parts)), "[^a-z0-9가-힣]+", "-"), "^-+|-+$", "")


def url_path(text: Column) -> Column:
    """Percent-encoded, with a blank as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def channel(host: Column, table: list[tuple[str, str]]) -> Column:
    """The channel of a referring host: the first entry that equals it or is its parent domain."""
    hits = [F.when((host == domain) | host.endswith(f".{domain}"), F.lit(name)) for domain, name in table]
    return F.when(host.isNull(), F.lit("direct")).otherwise(F.coalesce(*hits, F.concat(F.lit("host:"), host)))


def path_kind(path: Column, table: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(path.startswith(prefix), F.lit(kind)) for prefix, kind in table], F.lit("other"))
