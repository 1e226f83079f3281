"""Secret scans: fixed patterns, and windows of high entropy over candidate strings.

Everything is column expressions over one row, so the scan has no shuffle. Positions are code
points. The patterns are looked for leftmost and without overlap, each kind for itself. A
candidate is a run of 20 or more characters of keys and tokens. A window of 20 slides over it;
the counts of its characters change by one in and one out at each step, and so does the entropy.
Long candidates are cut into blocks that share what a window needs, so the work grows with their
length. No pattern repeats a group that the regular expressions would follow by recursion.
Windows over the bound of the candidate's class are joined into spans. Candidates on the
allow-list are no secrets: words of one case, digits alone, identifiers in the form of a UUID.
A window that holds a placeholder word does not count; other windows of its candidate do. Spans
that lie within one found by a pattern are not added; those that reach beyond it are.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import beside, pinned, text_of

# Patterns and least lengths of the kinds, in order of rank.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Bits per character above which a window counts, by class of the candidate.
HEX_BITS, MIXED_BITS = 3.0, 3.75
# Candidates that are no secrets.
ALLOWED = "|".join([
    r"[a-z_=-]+", r"[A-Z_=-]+", r"[A-Z]?[a-z/_=-]+", r"[0-9_=-]+", r"(?:[A-Za-z]++[/_-])++[A-Za-z]++",
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
])
# Words of placeholders, which clear the windows that hold them.
PLACEHOLDER = r"(?i)(?:example|placeholder|changeme|dummy|your_|xxxxx|00000000|12345678|abcdefgh)"
BLOCK = 512
# Windows of a candidate that are worked off together.
BLOCK_WINDOWS = 237
# Sums that differ by rounding alone are equal.
EQUAL = 1e-9
SPAN = "array<struct<s:bigint,e:bigint>>"
REDACTED = "[SECRET]"


def _placed(parts: Column, found: Column) -> Column:
    """(s, e) of every match, from the texts between matches and the matches.

    Sums run in blocks, so that a text with very many matches is not copied once per match.
    """
    pairs = F.arrays_zip(
        F.transform(F.slice(parts, 1, F.size(found)), lambda p: F.char_length(p).cast("bigint")).alias("gap"),
        F.transform(found, lambda m: F.char_length(m).cast("bigint")).alias("len"),
    )
    empty = F.array().cast(SPAN)

    def step(acc, x):
        span = F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["len"]).alias("e"))
        return F.struct(span["e"].alias("at"), acc["all"].alias("all"), F.array_append(acc["part"], span).alias("part"))

    def block(acc, i):
        start = F.struct(acc["at"].alias("at"), acc["all"].alias("all"), empty.alias("part"))
        return F.aggregate(
            F.slice(pairs, i * BLOCK + 1, BLOCK), start, step,
            lambda a: F.struct(a["at"].alias("at"), F.concat(a["all"], a["part"]).alias("all")),
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("all"))
    blocks = F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(blocks, zero, block, lambda a: a["all"]))


def _bound_once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, not at every step that reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hot(block: Column, bound: Column) -> Column:
    """Starts of the block's windows with at least ``bound`` bits per character and no placeholder."""
    weight = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 1)]
    # What one more of a character adds to the sum of count * log2(count), by how many there are.
    more = F.array(*[F.lit(weight[c + 1] - weight[c]) for c in range(WINDOW)])

    def changes(codes):
        """Per character: the sum's change as it comes in and the one WINDOW places before goes out."""
        def equal(i, code, places):
            found = [F.when(F.get(codes, i + k) == code, 1).otherwise(0) for k in places]
            return F.get(more, reduce(lambda x, y: x + y, found))

        def change(code, i):
            out = i - WINDOW
            gone = equal(out, F.get(codes, out), range(1, WINDOW))
            return equal(i, code, range(1 - WINDOW, 0)) - F.when(i >= WINDOW, gone).otherwise(0.0)

        return F.transform(codes, change)

    def step(acc, change, masked):
        total, start = acc["sum"] + change, acc["n"] + 1 - WINDOW
        hot = (start >= 0) & (math.log2(WINDOW) - total / WINDOW >= bound - EQUAL)
        clear = ~masked | ~F.substring(block, start + 1, F.lit(WINDOW)).rlike(PLACEHOLDER)
        out = F.when(hot & clear, F.array_append(acc["out"], start)).otherwise(acc["out"])
        return F.struct(total.alias("sum"), (acc["n"] + 1).alias("n"), out.alias("out"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    codes = F.transform(F.split(block, ""), lambda c: F.ascii(c))
    return _bound_once(block.rlike(PLACEHOLDER), lambda masked: F.aggregate(
        _bound_once(codes, changes), start, lambda acc, x: step(acc, x, masked), lambda acc: acc["out"]))


def _windows(candidate: Column, bound: Column) -> Column:
    """Spans (from the candidate's start) of its windows with at least ``bound`` bits per character and no placeholder.

    Candidates are ASCII, so blocks are cut as bytes; a block shares WINDOW - 1 characters with the next, so that each
    window is in one.
    """
    blocks = F.sequence(F.lit(0), F.char_length(candidate) - WINDOW, F.lit(BLOCK_WINDOWS))
    block = lambda data, at: F.substring(data, at + 1, F.lit(BLOCK_WINDOWS + WINDOW - 1)).cast("string")
    hot = _bound_once(bound, lambda least: _bound_once(candidate.cast("binary"), lambda data: F.flatten(F.transform(
        blocks, lambda at: F.transform(_bound_once(block(data, at), lambda b: _hot(b, least)), lambda x: x + at)))))
    # A span begins at a window that touches none before, and ends with one that touches none after.
    first = lambda starts: F.filter(starts, lambda x, i: F.coalesce(F.get(starts, i - 1) + WINDOW < x, F.lit(True)))
    last = lambda starts: F.filter(starts, lambda x, i: F.coalesce(F.get(starts, i + 1) > x + WINDOW, F.lit(True)))
    return _bound_once(hot, lambda starts: F.zip_with(first(starts), last(starts), lambda a, z: F.struct(
        a.cast("bigint").alias("s"), (z + WINDOW).cast("bigint").alias("e"))))


def _kind(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``base`` and ``found``: arrays of (s, rank, e, kind), in order, without and with entropy spans.

    A null or empty text has none; texts and candidates of any length are scanned whole. Nothing else is read, so nulls elsewhere, ties and repeated rows
    change nothing; given columns named ``base`` or ``found`` are replaced.
    """
    given = docs.columns
    t = F.col("_t")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"), text_of(text).alias("_t"))
    rows = rows.withColumns({
        "_assign": F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0)),
        "_access": F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)),
        "_hex": F.regexp_extract_all(t, F.lit(HEX), F.lit(0)),
        "_cand": F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)),
    })
    empty = F.array().cast(SPAN)
    cut = lambda name, pattern: F.when(F.size(name) > 0, F.split(t, pattern))
    rows = rows.withColumns({
        "_assign_cut": cut("_assign", ASSIGN), "_access_cut": cut("_access", ACCESS), "_hex_cut": cut("_hex", HEX),
        "_cand_cut": F.when(F.exists("_cand", lambda c: ~c.rlike(f"^(?:{ALLOWED})$")), F.split(t, CANDIDATE)),
    })
    rows = rows.withColumns({
        f"_{k}_at": F.when(F.col(f"_{k}_cut").isNull(), empty).otherwise(_placed(F.col(f"_{k}_cut"), F.col(f"_{k}")))
        for k in ("assign", "access", "hex", "cand")
    })
    # The match without its name and sign is the value; the span is the whole match.
    long_value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    zipped = lambda k: F.arrays_zip(F.col(f"_{k}").alias("m"), F.col(f"_{k}_at").alias("at"))
    kept = lambda k, test: F.when(F.size(f"_{k}_at") == 0, empty).otherwise(
        F.transform(F.filter(zipped(k), lambda x: test(x["m"])), lambda x: x["at"]))
    base = F.sort_array(F.concat(
        _kind(kept("assign", long_value), 0, "assign"),
        _kind(kept("access", lambda m: F.char_length(m) >= ACCESS_LEAST), 1, "access"),
        _kind(F.col("_hex_at"), 2, "hex"),
    ))
    rows = rows.withColumn("base", pinned(base))

    bound = lambda c: F.when(c.rlike("^[0-9a-fA-F]+$"), HEX_BITS).otherwise(MIXED_BITS)
    high = F.flatten(F.transform(
        F.filter(zipped("cand"), lambda x: ~x["m"].rlike(f"^(?:{ALLOWED})$")),
        lambda x: F.transform(_windows(x["m"], bound(x["m"])), lambda w: F.struct(
            (x["at"]["s"] + w["s"]).alias("s"), (x["at"]["s"] + w["e"]).alias("e"))),
    ))
    rows = rows.withColumn("_high", F.when(F.size("_cand_at") == 0, empty).otherwise(high))
    beyond = F.filter("_high", lambda h: ~F.exists("base", lambda b: (b["s"] <= h["s"]) & (h["e"] <= b["e"])))
    rows = rows.withColumn("found", pinned(F.sort_array(F.concat("base", _kind(beyond, 3, "entropy")))))
    return beside(rows, "row", given, ["base", "found"])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with every secret span replaced by REDACTED; other texts stay as they are.

    Overlapping spans are joined first, so no part of a secret stays.
    """
    given = docs.columns
    rows = scan_secrets(docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"), F.col(f"`{text}`").alias("_text")), "_text")

    def step(acc, x):
        fresh = x["s"] >= acc["at"]
        gap = F.substring(F.col("_text"), (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        return F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(REDACTED)))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = F.expr("2147483647")
    masked = F.aggregate("found", start, step, lambda a: F.array_join(
        F.array_append(a["out"], F.substring(F.col("_text"), (a["at"] + 1).cast("int"), rest)), ""))
    clean = F.when(F.size("found") > 0, masked).otherwise(F.col("_text"))
    return rows.select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in given])


def secret_digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: numbers of base spans by kind, their digest, and all spans as text."""
    found = scan_secrets(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_text")), "_text")
    number = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
    )
