"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text is cut into paragraphs: lines, and stretches of at most PARAGRAPH_WORDS words of a longer line.
Each distinct paragraph has a 64-bit digest. A sketch is an array of cells; each digest is added to
three of them, and a cell holds how many digests it got, their exclusive or, and that of their checks.

To compare two versions their sketches are subtracted cell by cell: what both have cancels out. Cells
left with a single digest give it up, it is taken out of its other cells, and so on until nothing is
left: the digests recovered are the paragraphs that differ. A document's fingerprint is a sketch of
FINGERPRINT_CELLS cells, and fingerprints are what is subtracted first. If cells remain, they were too small for what
differs, and larger sketches are made for this pair, again and again. So that these cost the same per paragraph
for any length, the digests of the pair are first dealt by their own bits over groups of about GROUP_DIGESTS,
and each group has sketches of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.llm.shared import documents, stored, text_or_empty

PARAGRAPH_WORDS = 24
GROUP_DIGESTS = 8
#: Cells of a fingerprint.
FINGERPRINT_CELLS = 24
#: Cells of a group's sketch, and of those made after failures.
CELLS = (24, 48, 96)
ROUNDS = 24
PARAGRAPHS = rf"\S++(?:[^\S\n]++\S++){{0,{PARAGRAPH_WORDS - 1}}}+"
LEAST = -(2**63)


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    return F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPHS), F.lit(0)), lambda p: F.xxhash64(p))
    )


def check(digest_sql: str) -> str:
    """The check of a digest, of 32 bits."""
    return f"hash({digest_sql}, 7)"


def sketch_sql(digests_sql: str, cells: int) -> str:
    """A sketch of an array of digests: cells of count c, digests k and checks h.

    The cells are in three parts; a digest has one in each, by other bits of it.
    """
    part = cells // 3
    places = ", ".join(f"named_struct('s', {21 * (i // part)}, 'p', {i % part}L)" for i in range(cells))
    return f"""transform(array({places}), q -> aggregate(
        filter({digests_sql}, x -> pmod(shiftrightunsigned(x, q.s), {part}L) = q.p),
        named_struct('c', 0, 'k', 0L, 'h', 0),
        (t, x) -> named_struct('c', t.c + 1, 'k', t.k ^ x, 'h', t.h ^ {check('x')})))"""


def peeled_sql(first: str, second: str, cells: int) -> str:
    """How many digests two sketches of this size differ by; null if they can't be told apart."""
    part = cells // 3
    difference = f"""zip_with({first}, {second}, (u, v) -> named_struct('c', u.c - v.c, 'k', u.k ^ v.k, 'h', u.h ^ v.h))"""
    single = f"""array_distinct(transform(
        filter(t.cells, c -> abs(c.c) = 1 AND {check('c.k')} = c.h), c -> named_struct('c', c.c, 'k', c.k)))"""
    hits = f"pmod(shiftrightunsigned(x.k, 21 * cast(i div {part} AS int)), {part}L) = i % {part}"
    taken = f"""transform(t.cells, (c, i) -> aggregate(filter(g, x -> {hits}), c,
        (y, x) -> named_struct('c', y.c - x.c, 'k', y.k ^ x.k, 'h', y.h ^ {check('x.k')})))"""
    step = f"""transform(array({single}), g -> named_struct(
        'cells', CASE WHEN size(g) = 0 THEN t.cells ELSE {taken} END, 'n', t.n + size(g), 'over', size(g) = 0))[0]"""
    return f"""aggregate(sequence(1, {ROUNDS}), named_struct('cells', {difference}, 'n', 0, 'over', false),
        (t, r) -> CASE WHEN t.over THEN t ELSE {step} END,
        t -> CASE WHEN forall(t.cells, c -> c.c = 0 AND c.k = 0 AND c.h = 0) THEN t.n END)"""


def tried_sql(first: str, second: str) -> Column:
    """The difference of two arrays of digests by their fingerprints; null if these can't tell, as they surely can't where one text
    has more digests than there are cells beyond the other's.
    """
    peeled = peeled_sql(f"{first}_sketch", f"{second}_sketch", FINGERPRINT_CELLS)
    return F.expr(f"CASE WHEN abs(size({first}) - size({second})) <= {FINGERPRINT_CELLS} THEN {peeled} END")


def difference_sql(first: str, second: str) -> str:
    """The size of the symmetric difference of two arrays of distinct digests, by sketches of growing size.

    Should every size fail, which takes digests that share all their cells, they are compared outright.
    """
    tries = ", ".join(peeled_sql(sketch_sql(first, m), sketch_sql(second, m), m) for m in CELLS)
    return f"""coalesce({tries}, size(array_except({first}, {second})) + size(array_except({second}, {first})))"""


def shown(sketch: str, n: str) -> Column:
    """A fingerprint in hexadecimal: the number of digests, then of each cell the number of its digests, their exclusive or, and their check.

    The number of a cell is that modulo 65,536, as differences of numbers are all that subtracting needs.
    """
    cell = "concat(lpad(hex(c.c & 65535), 4, '0'), lpad(hex(c.k), 16, '0'), lpad(right(hex(c.h), 8), 8, '0'))"
    return F.expr(f"concat(lpad(hex({n}), 8, '0'), array_join(transform({sketch}, c -> {cell}), ''))")


def groups_for(n: Column) -> Column:
    """A power of two: into how many groups the digests of a pair with ``n`` in all are dealt."""
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / GROUP_DIGESTS)))).cast("long")


def followers(rows: DataFrame) -> DataFrame:
    """at, next_at, need and n for each distinct ``at``: the id that follows it, the first after the last.

    ``need`` is half the length of the longest text at ``at``, rounded down, and ``n`` how many there are. Ids are dealt
    out by range, each range is ordered on its own, and the ranges' first ids close the gaps between them.
    """
    slim = rows.groupBy("at").agg(F.max(F.floor(F.length("text") / 2)).alias("need"), F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(slim.repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("part").agg(F.min("at").alias("first"))
    # one row for each range: as many as there are shuffle partitions
    after = Window.orderBy("part")
    least = F.min("first").over(after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    borders = firsts.select("part", F.coalesce(F.lead("first").over(after), least).alias("first_after"))
    inside = Window.partitionBy("part").orderBy("at")
    return (
        ranged.withColumn("inner_next", F.lead("at").over(inside))
        .join(F.broadcast(borders), "part")
        .select("at", F.coalesce("inner_next", "first_after").alias("next_at"), "need", "n")
    )


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """at, text, head (what edits take of the next text) and next_own (its digests).

    Of rows that repeat an id the one with the smallest text is the next document of others.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("at"), text_or_empty(text_col).alias("text")
    )
    order = stored(followers(rows), "followers")
    before = order.select(F.col("next_at").alias("at"), F.col("at").alias("before"), "need")
    nexts = rows if order.filter("n > 1").isEmpty() else rows.groupBy("at").agg(F.min("text").alias("text"))
    heads = nexts.join(before, "at").select(
        F.col("before").alias("at"), F.expr("substring(text, 1, cast(need AS int))").alias("head"), digests(F.col("text")).alias("next_own")
    )
    return rows.join(heads, "at")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, the two fingerprints and likenesses, and how these were got.

    The likeness of two fingerprints is the share of paragraph digests that both have among those that
    either has, from the number that peeling recovers: 1 if neither has any. ``edited_by_fingerprint`` and
    ``next_by_fingerprint`` say whether subtracting the fingerprints themselves gave it; else larger sketches of the same
    digests did. A null text counts as empty; a null id comes before all others; rows that repeat an id follow the same next
    document, of which the row with the smallest text counts; a single document follows itself; an empty table gives no
    rows. Other columns are not read.
    """
    half = "cast(floor(length(text) / 2) AS int)"
    both = with_next(docs, id_col, text_col).select(
        "at", F.length("text").cast("long").alias("n_chars"), digests(F.col("text")).alias("own"), "next_own",
        F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(head, 1, {half}))").alias("edited"),
    )
    digested = both.select(
        "at", "n_chars", "own", "next_own", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited")).alias("edited_own")
    )
    sketched = digested.select(
        "*", *[F.expr(sketch_sql(c, FINGERPRINT_CELLS)).alias(f"{c}_sketch") for c in ("own", "edited_own", "next_own")]
    )
    tried = sketched.select(
        "at", "n_chars", "edited_sha256", "own_sketch", "edited_own_sketch", "own", "edited_own", "next_own",
        *[F.size(c).alias(f"n_{c}") for c in ("own", "edited_own", "next_own")],
        *[tried_sql("own", c).alias(f"{c.split('_')[0]}_differs") for c in ("edited_own", "next_own")],
    )
    # all of a document's rows stay where the join by its id has put them: what follows needs no shuffle
    about = F.struct(
        "n_chars", "edited_sha256", "own_sketch", "edited_own_sketch", "n_own", "n_edited_own", "n_next_own", "edited_differs", "next_differs"
    )
    numbered = tried.withColumn("row", F.monotonically_increasing_id()).withColumn("about", about)

    def dealt(pair: int, side: int, column: str, other: str, unless: str) -> Column:
        groups = groups_for(F.col("n_own") + F.col(other))
        entries = F.transform(
            column,
            lambda x: F.struct(
                F.lit(pair).alias("pair"),
                F.pmod(F.shiftrightunsigned(x, 8), groups).alias("group"),
                F.lit(side).alias("side"),
                x.alias("digest"),
            ),
        )
        return F.when(F.col(unless).isNull(), entries).otherwise(F.slice(entries, 1, 0))

    nothing = F.array(
        F.struct(
            F.lit(0).alias("pair"), F.lit(0).cast("long").alias("group"), F.lit(-1).alias("side"),
            F.lit(0).cast("long").alias("digest"),
        )
    )
    entries = F.concat(
        nothing,
        dealt(0, 0, "own", "n_edited_own", "edited_differs"), dealt(0, 1, "edited_own", "n_edited_own", "edited_differs"),
        dealt(1, 0, "own", "n_next_own", "next_differs"), dealt(1, 1, "next_own", "n_next_own", "next_differs"),
    )
    exploded = numbered.select("at", "row", "about", F.explode(entries).alias("e")).select(
        "at", "row", "e.pair", "e.group", "e.side", "e.digest", F.when(F.col("e.side") == -1, F.col("about")).alias("about")
    )
    of_side = [F.collect_list(F.when(F.col("side") == s, F.col("digest"))).alias(c) for s, c in ((0, "a"), (1, "b"))]
    grouped = exploded.groupBy("at", "row", "pair", "group").agg(*of_side, F.first("about", ignorenulls=True).alias("about"))
    counted = grouped.withColumn("n", F.expr(difference_sql("a", "b")))
    per_row = counted.groupBy("at", "row").agg(
        F.sum(F.when(F.col("pair") == 0, F.col("n"))).alias("edited_found"),
        F.sum(F.when(F.col("pair") == 1, F.col("n"))).alias("next_found"),
        F.first("about", ignorenulls=True).alias("about"),
    )

    def likeness(other: str, differs: Column) -> Column:
        total = F.col("about.n_own") + F.col(f"about.{other}")
        return F.when(total == 0, F.lit(1.0)).otherwise((total - differs) / (total + differs)).cast("double")

    return per_row.select(
        F.nullif(F.col("at"), F.lit(LEAST)).alias("doc_id"),
        "about.n_chars",
        "about.edited_sha256",
        shown("about.own_sketch", "about.n_own").alias("fingerprint"),
        shown("about.edited_own_sketch", "about.n_edited_own").alias("edited_fingerprint"),
        likeness("n_edited_own", F.coalesce("about.edited_differs", "edited_found")).alias("near_edited"),
        likeness("n_next_own", F.coalesce("about.next_differs", "next_found")).alias("near_next"),
        F.col("about.edited_differs").isNotNull().alias("edited_by_fingerprint"),
        F.col("about.next_differs").isNotNull().alias("next_by_fingerprint"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how like each other and the next document's they are."""
    return fingerprint_documents(documents(spark, sf_dir))
