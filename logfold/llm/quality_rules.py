"""Quality rules that look at lines first.

Each line is judged for itself: does a long one hold the end of a sentence, is it a bar of links,
is it short or mostly made of standing phrases of web pages? Failing lines are removed, and a document that loses too much of
its text is rejected. Next to this stand counts over the whole text, two of which reject as well.
All of it is column expressions over one row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import SPACE, WORD, beside, pinned, text_of

# Fixed values of the base rules.
LEAST_WORDS, REPEAT_PERCENT, GRAM = 10, 20, 5
SYMBOLS = r"[#*$%&|<>]"
# A line of prose ends so or has a STOP within; shorter lines (titles, list items) need not.
SENTENCE_ENDS = [*".!?…。！？؟۔।॥።｡．；：:;\"'”’»)]」』】》›"]
# The end of a sentence within a line.
STOP = r"[.!?…؟۔।॥።．][\"'”’»)\]」』]*(?=[\x20\x09-\x0D]|$)|[。！？｡]"
BLANKS = " \t\n\x0b\x0c\r"
SHORT_LINE_WORDS = 8
# Navigation: a line with this many separators per word.
SEPARATORS = r"[|•·»›→]|\x20[/>]\x20"
SEPARATORS_PER_WORD = 0.25
# Marks at the ends of words in at least this share of a line's words make it no prose.
MARKED = r"(?:[#*$%&]{2,}|!!)(?=[\x20\x09-\x0D]|$)"
MARKED_PER_WORD = 0.3
# Standing phrases of web pages, in lower case.
BOILERPLATE = (r"\b(?=[acpstjl])(?:all rights reserved|cookie (?:policy|settings)|accept (?:all )?cookies|privacy policy|terms of (?:use|service)|"
               r"subscribe to our newsletter|click here|javascript (?:is|must be)|sign in|log ?in to|skip to (?:main )?content|lorem ipsum)\b")
# A standing phrase fails a line of so many words at most, or one with a phrase per so many words.
PHRASE_LINE_WORDS, WORDS_PER_PHRASE = 20, 8
# A document goes when it keeps less than this share of its characters.
LEAST_KEPT = 0.5
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "kept"]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _line_fails(line: Column, n: Column) -> Column:
    """True for lines to remove, ``n`` being their words; a line without a word never is."""
    no_end = ~F.substring(F.rtrim(line, F.lit(BLANKS)), -1, 1).isin(SENTENCE_ENDS) & (n > SHORT_LINE_WORDS) & ~line.rlike(STOP)
    navigation = F.regexp_count(line, F.lit(SEPARATORS)) >= F.greatest(F.lit(2), n * SEPARATORS_PER_WORD)
    marked = F.regexp_count(line, F.lit(MARKED)) >= F.greatest(F.lit(2), n * MARKED_PER_WORD)
    low = F.lower(line)
    phrases = low.rlike(BOILERPLATE) & (
        (n <= PHRASE_LINE_WORDS) | (F.regexp_count(low, F.lit(BOILERPLATE)) * WORDS_PER_PHRASE >= n))
    return (n > 0) & (no_end | navigation | marked | phrases)


def _placed(grams: Column) -> Column:
    """Windows' hashes with their places, sorted, so that equal windows are neighbours."""
    return F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))


def _repeat_words(placed: Column) -> Column:
    """Words covered by windows that equal another one, each counted once.

    Windows that equal a neighbour go back in order of place; each adds what the one before has not covered.
    """
    same = lambda x, k: F.coalesce(F.get(placed, k)["g"] == x["g"], F.lit(False))
    twice = F.filter(placed, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, k - 1)))
    return F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(-GRAM).alias("at"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(GRAM), i - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )


def quality_rules(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row with the base counts, ``base_failed``, ``clean_text`` and ``kept``.

    ``clean_text`` is the text without its failing lines. A null or empty text has no words, fails
    and is not kept. Rows are judged alone: ties, repeated rows and nulls elsewhere change nothing.
    Given columns with the name of a result are replaced. Equality of windows is that of 64-bit hashes.
    """
    given = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"), text_of(text).alias("_t"))
    rows = rows.withColumns({"_words": _words(F.col("_t")), "_lines": F.split("_t", "\n")})
    rows = rows.withColumns({
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "_counted_lines": F.transform("_lines", lambda x: F.struct(
            x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"))),
    })
    rows = rows.withColumn("_left_lines", F.transform(
        F.filter("_counted_lines", lambda x: ~_line_fails(x["line"], x["n"])), lambda x: x["line"]))
    h = F.col("_hashes")
    grams = F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - (GRAM - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, GRAM)]),
    )
    worded = F.transform(F.filter("_counted_lines", lambda x: x["n"] > 0), lambda x: x["line"])
    rows = rows.withColumns({"_grams": grams, "_worded": worded, "clean_text": F.array_join("_left_lines", "\n")})
    rows = rows.withColumn("_again", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    rows = rows.withColumn("_placed", F.when(F.col("_again"), _placed(F.col("_grams"))))
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("bigint"),
        "n_repeat_words": F.when(F.col("_again"), _repeat_words(F.col("_placed"))).otherwise(F.lit(0)).cast("bigint"),
    })
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    rows = rows.withColumn("kept", pinned(~F.col("base_failed") & (F.char_length("clean_text") >= LEAST_KEPT * F.char_length("_t"))))
    return beside(rows, "row", given, RESULTS)
