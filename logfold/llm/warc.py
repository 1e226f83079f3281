"""WARC archives: written by Spark's text writer, read back by a chain of record boundaries.

Every part file is an archive. The reader cuts files at the magic string wherever it stands, in
payloads as well, so that any task can start at any split. Each cut is a candidate: its header says
how long the record is and so where the next one starts. From the start of every file, pointer jumping
finds the offsets that the chain of records reaches, in as many passes as the logarithm of their
number; other candidates are magic strings inside payloads, and their text goes back into the record around them.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfold.llm.common import join_groups, shared_folder, stored, text_of

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
# Equal payloads of at least so many bytes are stored once.
LEAST_SHARED = 100
DATE = "1970-01-01T00:00:00Z"
PLACE = ["_file", "_split", "_row"]


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str | None = "url", payload: str = "html",
                   date: str = DATE) -> None:
    """Write a record per row below ``path``, one archive per task.

    Of equal payloads of at least LEAST_SHARED bytes the smallest id becomes the response and all other ids revisit
    it, without a payload of their own. A null payload is empty. Rows that repeat the smallest id are responses too; a row
    with a null id in a group with ids revisits the smallest. Line breaks in a URL are escaped. An empty table writes no record.
    """
    uri = F.regexp_replace(text_of(url), "[\r\n]", "%0A") if url else F.lit("")
    rows = pages.select(F.col(id).cast("bigint").alias("_id"), uri.alias("_uri"), text_of(payload).alias("_payload"))
    rows = rows.withColumns({"_bytes": F.octet_length("_payload"), "_digest": F.sha2("_payload", 256)})
    shared = rows.filter(F.col("_bytes") >= LEAST_SHARED).groupBy("_digest").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _first is not null")
    shared = stored(shared.withColumnRenamed("_digest", "_key"), "shared")
    if shared.isEmpty():
        rows = rows.withColumn("_first", F.lit(None).cast("bigint"))
    else:
        key = F.when(F.col("_bytes") >= LEAST_SHARED, F.col("_digest"))
        rows = join_groups(rows.withColumn("_key", key), shared, "_key", "_id")
    revisit = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("_uri")),
        F.when(revisit, line("WARC-Refers-To", name(F.col("_first")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, 0).otherwise(F.col("_bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("_payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """What follows each magic string, with its place: file, split, and row number in the task."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"))


def _candidates(cuts: DataFrame, columns: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Candidates with offset, successor, header, and, where the payload is all there, its columns."""
    # The text before a file's first magic string is a row as well; it carries the offset, and is no candidate.
    head = F.when(F.instr("value", END) > 0, F.substring_index("value", END, 1))
    said = F.regexp_extract("_head", r"(?:^|\r\n)Content-Length: ([0-9]{1,18})(?:\r\n|$)", 1)
    rows = cuts.withColumn("_head", head).withColumn("_length", F.nullif(said, F.lit("")).cast("bigint"))
    skip = F.octet_length("_head") + len(END)
    body = F.substr("value", F.char_length("_head") + len(END) + 1)
    rows = rows.withColumns({"_size": F.octet_length("value") + len(MAGIC), "_body": F.when(F.col("_length").isNotNull(), body)})
    whole = F.col("_body").endswith(END) & (F.octet_length("_body") == F.col("_length") + len(END))
    payload = F.when(whole, F.substr("_body", F.lit(1), F.char_length("_body") - len(END)))
    rows = rows.withColumn("_payload", payload)
    rows = rows.select(
        *PLACE, "_size", "_head", "_length", (len(MAGIC) + skip + F.col("_length") + len(END)).alias("_span"),
        F.coalesce(whole, F.lit(False)).alias("_whole"), *[make(F.col("_payload")).alias(c) for c, make in columns.items()])
    within = Window.partitionBy("_file", "_split").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("_file", "_split").agg(F.sum("_size").alias("_all"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("_file", "_split", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    placed = rows.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(base, ["_file", "_split"])
    # The magic string of a row stands right before its text.
    offset = F.col("_base") + F.col("_in") - len(MAGIC)
    return placed.withColumn("_at", offset).filter("_at >= 0").withColumn("_next", F.col("_at") + F.col("_span")).drop("_base", "_in", "_size", "_span")


def reachable(steps: DataFrame) -> DataFrame:
    """(_file, _at) that the chain from offset 0 of each file reaches, for steps (_file, _at, _next).

    The set of known offsets and the length of a jump double in every pass.
    """
    known = stored(steps.filter("_at = 0").select("_file", "_at").distinct(), "reached")
    real = steps.select("_file", F.col("_at").alias("_next"))
    jumps = stored(steps.filter("_next is not null").join(real, ["_file", "_next"], "left_semi").select("_file", "_at", "_next"), "jumps")
    while not jumps.isEmpty():
        more = known.join(jumps, ["_file", "_at"]).select("_file", F.col("_next").alias("_at"))
        known = stored(known.unionByName(more).distinct(), "reached")
        after = jumps.select("_file", F.col("_at").alias("_next"), F.col("_next").alias("_then"))
        jumps = stored(jumps.join(after, ["_file", "_next"]).select("_file", "_at", F.col("_then").alias("_next")), "jumps")
    return known


def read_records(spark: SparkSession, path: str, columns: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(record_id, record_type, refers_to, digest) of every record below ``path``, and ``columns`` made from its payload.

    ``columns`` maps names to expressions over the payload; the payload itself by default. They are computed where
    the archive is read, so payloads move only if asked for or cut by a magic string inside them.
    """
    columns = columns or {"payload": lambda p: p}
    found = stored(_candidates(_cuts(spark, path), columns), "candidates")
    true = reachable(found.select("_file", "_at", "_next"))
    records = found.join(true, ["_file", "_at"])
    cut = records.filter(~F.col("_whole")).select("_file", "_at", "_next")
    if not cut.isEmpty():
        records = records.filter("_whole").unionByName(_mended(spark, path, found, cut, records, columns))
    field = lambda name, value: F.nullif(F.regexp_extract("_head", rf"(?:^|\r\n){name}: {value}(?:\r\n|$)", 1), F.lit(""))
    return records.select(
        field("WARC-Record-ID", "<urn:page:([0-9-]*)>").cast("bigint").alias("record_id"),
        field("WARC-Type", r"([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:([0-9-]+)>").cast("bigint").alias("refers_to"),
        field("WARC-Payload-Digest", "sha256:([0-9a-f]+)").alias("digest"), *columns)


def _mended(spark: SparkSession, path: str, found: DataFrame, cut: DataFrame, records: DataFrame, columns: dict) -> DataFrame:
    """Records whose payload holds the magic string: all cuts from their start to the next record, put together."""
    starts = cut.select("_file", F.col("_at").alias("_start"), F.col("_next").alias("_stop"))
    # Walk each file's candidates in order with the last start before them; a file's candidates are few and narrow.
    over = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    marked = found.select(*PLACE, "_at").join(starts.withColumn("_at", F.col("_start")), ["_file", "_at"], "left")
    inside = marked.withColumns({
        "_start": F.last("_start", True).over(over), "_stop": F.last("_stop", True).over(over),
    }).filter("_at < _stop").select(*PLACE, "_start", "_at")
    parts = _cuts(spark, path).join(inside, PLACE)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), MAGIC)
    whole = parts.groupBy("_file", F.col("_start").alias("_at")).agg(text.alias("_text"))
    given = records.filter(~F.col("_whole")).drop(*columns)
    body = F.substr("_text", F.char_length("_head") + len(END) + 1)
    mended = given.join(whole, ["_file", "_at"]).withColumn("_payload", F.substr(body, F.lit(1), F.char_length(body) - len(END)))
    return mended.select(*given.columns, *[make(F.col("_payload")).alias(c) for c, make in columns.items()])


def warc_round_trip(pages: DataFrame, id: str = "page_id", url: str | None = "url", payload: str = "html") -> DataFrame:
    """Write the pages to archives, read these back: (page_id, payload_bytes, payload_digest, record_type, refers_to) per row.

    Bytes and digest are of payloads as read; a revisit has those of the record that it refers to. See
    `write_archives` for nulls, ties and repeated rows.
    """
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archives(pages, path, id, url, payload)
    read = stored(read_records(spark, path, {"payload_bytes": lambda p: F.octet_length(p).cast("bigint"), "payload_digest": lambda p: F.sha2(p, 256)}), "records")
    own = read.filter("record_type = 'response'").select(
        F.col("record_id").alias(id), "payload_bytes", "payload_digest", "record_type", "refers_to")
    revisits = read.filter("record_type = 'revisit'").select("record_id", "record_type", "refers_to")
    sizes = revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("_n"))
    # Responses to one id twice, from repeated rows, have the payload that revisits mean under its digest.
    wanted = read.filter("record_type = 'revisit'").select("refers_to", "digest").distinct()
    targets = own.select(F.col(id).alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    targets = targets.join(wanted, (targets.refers_to == wanted.refers_to) & (targets.payload_digest == wanted.digest), "left_semi")
    full = join_groups(revisits, targets.join(sizes, "refers_to"), "refers_to", "record_id", "inner", sizes)
    return own.unionByName(full.select(F.col("record_id").alias(id), "payload_bytes", "payload_digest", "record_type", "refers_to"))
