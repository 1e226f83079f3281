"""Document fingerprints: the bottom k of the hashes of a text's shingles.

A shingle is a run of five words, hashed to 64 bits; a text of fewer words has one, its whole sequence. A
fingerprint holds the K smallest distinct hashes in order, so that of two parts the K smallest of both are
the fingerprint of the whole. From two fingerprints follow estimates of resemblance and containment of their
sets, from one the number of distinct shingles; sets of fewer than K shingles give exact numbers. Everything
is column expressions and joins.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.llm.common import SPACE, beside, lower_ascii, stored, text_of
from logfold.plans.scan import with_previous

SHINGLE = 5
K = 192
RESULTS = ["n_chars", "edited", "fingerprint", "edited_fingerprint", "n_shingles", "near_edited", "near_next"]
# Hashes are signed; so many lie below zero.
HALF, ALL = float(1 << 63), float(1 << 64)


def shingles(text: Column) -> Column:
    """Hashes of the shingles of a text, repeated ones included; words are split by white space and compared in lower case of A-Z."""
    words = F.filter(F.split(lower_ascii(text), f"[{SPACE}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # The words' hashes are bound once, outside of the steps that read them.
    return F.element_at(F.transform(F.array(hashed), lambda h: F.when(F.size(h) == 0, h).when(
        F.size(h) < SHINGLE, F.array(F.xxhash64(h))).otherwise(F.transform(
            F.slice(h, 1, F.size(h) - (SHINGLE - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + n) for n in range(1, SHINGLE)])))), 1)


def bottom(hashes: Column, k: int = K) -> Column:
    """The fingerprint of a set of hashes: its ``k`` smallest, in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    """The fingerprint of a text; without words it is empty. Null gives null."""
    return bottom(shingles(text), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of two sets together."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union of two sets that both have; 1 for two empty ones."""
    both = merged(a, b, k)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that the second has; 1 for an empty first set."""
    own = F.array_intersect(a, merged(a, b, k))
    return F.when(F.size(a) == 0, 1.0).when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, b)) / F.size(own))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    largest = (F.element_at(a, -1).cast("double") + F.lit(HALF)) / F.lit(ALL)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / largest)


def as_text(a: Column) -> Column:
    """A fingerprint as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merge_groups(rows: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """One fingerprint per group of rows with fingerprints. A group of any size sends ``k`` hashes per task; null ones add nothing."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_h"))
    few = rows.select(*by, F.explode(column).alias("_h")).distinct().withColumn("_place", place).filter(F.col("_place") <= k)
    found = few.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(column))
    every = rows.select(*by).distinct()
    known = [every[c].eqNullSafe(found[c]) for c in by]
    return every.join(found, known, "left").select(*[every[c] for c in by], F.coalesce(found[column], F.array().cast("array<bigint>")).alias(column))


def _beside_next(rows: DataFrame) -> DataFrame:
    """Rows (row, _key, _text) with ``next``: (prefix, sketch) of the text of the next smaller id; after the smallest comes the largest.

    Only ids are put in order, in buckets of ids. A text meets its successor as a sketch and as many
    characters as are asked for. Of texts with one id, the smallest stands for all.
    """
    need = F.floor(F.char_length("_text") / 3).cast("int")
    ids = stored(rows.select("_key", need.alias("need")).groupBy("_key").agg(F.max("need").alias("need")), "ids")
    # ~id grows as ids fall, and has no overflow.
    ordered = with_previous(ids.withColumn("_at", F.bitwise_not("_key")), [], "_at", ["_key", "need"])
    smallest = ids.agg(F.min(F.struct("_key", "need"))).scalar()
    asked = ordered.select("_key", F.coalesce("prev", smallest).alias("asked"))
    # The hash keeps the columns of both uses of the rows alike, so that texts are dealt out once.
    sent = rows.join(asked, "_key", "left").select(
        F.col("asked._key").alias("_key"),
        F.struct(F.expr("left(_text, asked.need)").alias("prefix"), sketch(F.col("_text")).alias("sketch"), F.xxhash64("row").alias("_row")).alias("next"))
    return rows.join(sent.groupBy("_key").agg(F.min("next").alias("next")), "_key", "left")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row with its fingerprint, that of an edited text, and how alike they are, and with the next document's.

    ``edited`` is the text with its last third, rounded down, replaced by as many first characters of the next document, by
    falling id; after the last comes the first. ``n_chars`` counts code points, ``n_shingles`` is an estimate. Likeness is
    the estimated resemblance, 1 between texts without words. A null text is empty. Ids are whole numbers; a null counts
    as the smallest. Rows with one id have the same next document, and of these the smallest text. A single id is its own
    next. Given columns with the name of a result are replaced. Very long texts are taken whole. An empty table gives no rows.
    """
    given = docs.columns if carry is None else carry
    key = F.coalesce(F.col(f"`{id}`").cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"), key.alias("_key"), text_of(f"`{text}`").alias("_text"))
    found = _beside_next(rows).withColumn("n_chars", F.char_length("_text").cast("bigint"))
    found = found.withColumn("edited", F.expr("concat(left(_text, int(n_chars - n_chars div 3)), left(next.prefix, int(n_chars div 3)))"))
    found = found.withColumns({"_sketch": sketch(F.col("_text")), "_edited": sketch(F.col("edited")), "_next": F.col("next.sketch")})
    found = found.withColumns({
        "fingerprint": as_text(F.col("_sketch")),
        "edited_fingerprint": as_text(F.col("_edited")),
        "n_shingles": distinct_count(F.col("_sketch")),
        "near_edited": resemblance(F.col("_sketch"), F.col("_edited")),
        "near_next": resemblance(F.col("_sketch"), F.col("_next")),
    })
    return beside(found, "row", given, RESULTS)
