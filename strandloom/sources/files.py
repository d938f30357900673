"""Sources and sinks: JSON stores, journals, dead letters, bus logs, folders, register descriptions, compiler output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

CHUNK = T.StructType([*(T.StructField(n, T.StringType()) for n in ("chunk_id", "doc_id", "path", "source_type", "text", "summary", "section")), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
JOURNAL = "id string, event_type string, source string, timestamp string, data string, metadata string, partition string, offset long, checksum string, version int"
TELEMETRY = "ts_ms long, task string, outcome string, model string, latency_ms long, prompt_token_estimate long, context string"


def _text(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk store: files with a JSON array of objects or one object a line; items that are no objects are dropped, texts trimmed, source_type 'pdf' by default."""
    whole = spark.read.text(path, wholetext=True)
    items = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.split("value", "\n"))
    each = whole.select(F.explode(items).alias("item")).filter(F.ltrim("item").startswith("{"))
    rows = each.select(F.from_json("item", CHUNK).alias("c")).select("c.*")
    kind = F.coalesce(F.nullif(F.trim("source_type"), F.lit("")), F.lit("pdf")).alias("source_type")
    return rows.filter("chunk_id IS NOT NULL OR text IS NOT NULL").select(*(kind if n == "source_type" else _text(n) for n in CHUNK.names if n != "metadata"), "metadata")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def journal_checksum() -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in ("id", "event_type", "source", "timestamp", "data"))), 256)


def append_journal(events: DataFrame, path: str, by: Column, version: int = 1) -> DataFrame:
    """Append events (id, event_type, source, timestamp, data, metadata) to partitions, with offsets that go on and checksums.

    Returns what was written. Offsets of one call follow timestamp, then id; one writer at a time is assumed.
    """
    from pyspark.sql import Window as W

    spark = events.sparkSession
    rows = events.withColumn("partition", by)
    try:
        last = read_journal(spark, path).groupBy("partition").agg((F.max("offset") + 1).alias("next"))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = spark.createDataFrame([], "partition string, next long")
    n = F.row_number().over(W.partitionBy("partition").orderBy("timestamp", "id")) - 1
    out = rows.join(last, "partition", "left").withColumn("offset", n + F.coalesce("next", F.lit(0))).withColumn("checksum", journal_checksum()).withColumn("version", F.lit(version)).drop("next")
    from strandloom.session import cut_lineage

    out = cut_lineage(out)
    out.withColumn("p", F.col("partition")).write.mode("append").partitionBy("p").json(path)
    return out


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """All partitions; lines that are no JSON are skipped."""
    return spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path).select(*[c.split()[0] for c in JOURNAL.split(", ")])


def invalid_checksums(journal: DataFrame) -> DataFrame:
    return journal.filter(F.coalesce(F.col("checksum") != journal_checksum(), F.lit(True)))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).option("mode", "DROPMALFORMED").json(path)


def write_json_array(rows: DataFrame, path: str, by: str) -> None:
    """One JSON array per value of ``by`` (dead letters of a queue); the array's lines are rows, so no list is gathered."""
    from pyspark.sql import Window as W

    order = W.partitionBy(by).orderBy(*rows.columns)
    n, top = F.row_number().over(order), F.count("*").over(W.partitionBy(by))
    line = F.concat(F.when(n == 1, "[").otherwise(" "), F.to_json(F.struct(*rows.columns)), F.when(n == top, "]").otherwise(","))
    rows.select(F.col(by).alias("p"), n.alias("_n"), line.alias("value")).repartition("p").sortWithinPartitions("p", "_n").drop("_n").write.mode("overwrite").partitionBy("p").text(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def frame_lines(frames: DataFrame, form: str) -> DataFrame:
    """Bus frames (ts, can_id, data binary) as lines of 'asc' or 'candump', or as rows for CSV and JSON writers."""
    data = F.hex("data")
    if form == "asc":
        spaced = F.trim(F.regexp_replace(data, "(..)", "$1 "))
        return frames.select(F.format_string("%.6f 1 %s Rx d %d %s", F.col("ts"), F.hex("can_id"), F.octet_length("data"), spaced).alias("value"))
    if form == "candump":
        return frames.select(F.format_string("[%.6f] %s#%s", F.col("ts"), F.hex("can_id"), data).alias("value"))
    return frames.select("ts", F.hex("can_id").alias("can_id"), data.alias("data"))


def walk(spark: SparkSession, path: str, suffixes: list[str], skip: list[str] = [".git", "node_modules", "__pycache__", "target", "build"]) -> DataFrame:  # noqa: B006
    """(path, mtime, size, content) of regular files with the suffixes, without dot files and skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(path)
    parts = F.split("path", "/")
    return files.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, skip))) & ~F.element_at(parts, -1).startswith(".")).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def read_registers(spark: SparkSession, path: str) -> DataFrame:
    """(peripheral, register, address, size) of device descriptions in XML; numbers may be hexadecimal; size 32 by default."""
    reg = "struct<name:string,addressOffset:string,size:string>"
    schema = f"name string, baseAddress string, registers struct<register:array<{reg}>>"
    rows = spark.read.format("xml").option("rowTag", "peripheral").schema(schema).load(path)
    number = lambda c: F.when(F.lower(c).startswith("0x"), F.conv(F.substring(c, 3, 16), 16, 10)).otherwise(c).try_cast("bigint")
    each = rows.select(F.col("name").alias("peripheral"), number(F.col("baseAddress")).alias("base"), F.explode("registers.register").alias("r"))
    return each.select("peripheral", F.col("r.name").alias("register"), (F.col("base") + number(F.col("r.addressOffset"))).alias("address"), F.coalesce(number(F.col("r.size")), F.lit(32)).alias("size"))


def diagnostics(lines: DataFrame, value: str = "value") -> DataFrame:
    """(file, line, column, severity, message) of compiler output 'file:line:column: severity: message'; other lines are dropped."""
    form = r"^([^:\s][^:]*):(\d+):(?:(\d+):)?\s*(fatal error|error|warning|note):\s*(.*)$"
    get = lambda i: F.regexp_extract(value, form, i)
    return lines.filter(F.col(value).rlike(form)).select(get(1).alias("file"), get(2).cast("int").alias("line"), get(3).try_cast("int").alias("column"), get(4).alias("severity"), get(5).alias("message"))


def sync_plan(local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """(key, action): upload what is only here, download what is only there, conflict where both differ (the remote row wins)."""
    a, b = local.select(key, F.md5(value).alias("_a")), remote.select(key, F.md5(value).alias("_b"))
    action = F.when(F.col("_b").isNull(), "upload").when(F.col("_a").isNull(), "download").when(F.col("_a") != F.col("_b"), "conflict")
    return a.join(b, key, "full_outer").select(key, action.alias("action")).filter("action IS NOT NULL")
