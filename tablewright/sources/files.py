"""Reading tables from files and describing the files themselves."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.ordered import number_rows
from tablewright.session import shared_folder
from tablewright.sources.delimited import read_by_header

# Words that mean "no value" in delimited text.
NULL_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
              "NULL", "NaN", "None", "n/a", "nan", "null")

# The largest file that is taken into memory as one value; a task holds several copies of it.
WHOLE_BYTES = 64 << 20


def null_words_out(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(*NULL_WORDS), F.col(c)) for c, t in df.dtypes if t == "string"})


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",", multiline: bool = False) -> DataFrame:
    """``columns`` by the names in the header row, all as text, null words out; types come later by safe conversion.

    The names are read from one file, and Spark checks the header of every other against them: a file with another order is an error, not a
    swap. With ``multiline`` cells may hold line ends, and every file's own header counts (see ``delimited``); both cost more passes.
    """
    if multiline:
        return null_words_out(read_by_header(spark, path, columns, sep))
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    names = reader.csv(path).columns
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"columns {missing} are not in the header {names}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return null_words_out(reader.option("enforceSchema", False).schema(schema).csv(path).select(*[F.col(f"`{c}`") for c in columns]))


def read_json_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files that hold an array of objects, one flat object, or an object with lists in it, whose first non-empty list of objects, in the
    order of the document, is the table. ``schema`` describes a record; without it the records are written once and inferred.

    A JSON document cannot be split, so it is one task per file; for large data write JSON lines and many files.
    """
    docs = spark.read.text(path, wholetext=True).select(F.ltrim(F.regexp_replace("value", r"^[\s\uFEFF]+", "")).alias("value"))
    texts = "array<string>"

    def objects(value: Column) -> Column:
        """The items of a list that is not empty and holds objects only, each as its own text; else null."""
        items = F.when(value.startswith("["), F.from_json(value, texts))
        return F.when((F.size(items) > 0) & F.forall(items, lambda x: F.coalesce(x.startswith("{"), F.lit(False))), items)

    # a map keeps the order of the document, and nested values as their text
    values = F.map_values(F.from_json("value", "map<string,string>"))
    nested = F.exists(values, lambda v: F.coalesce(v.startswith("[") | v.startswith("{"), F.lit(False)))
    lists = F.filter(F.transform(values, objects), lambda x: x.isNotNull())
    inner = F.when(~nested, F.array("value")).otherwise(F.get(lists, F.lit(0)))
    rows = docs.select(F.explode(F.when(F.col("value").startswith("["), objects(F.col("value"))).when(F.size(values) > 0, inner)).alias("value"))
    if schema is None:
        folder = shared_folder(spark)
        rows.select(F.regexp_replace("value", r"[\r\n]+", " ")).write.text(folder)  # line ends stand between tokens only
        return spark.read.json(folder)
    return rows.select(F.from_json("value", schema).alias("_r")).select("_r.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, raw_text): trimmed non-blank lines, numbered per file in file order."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block_start"),
        F.monotonically_increasing_id().alias("_seq"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("raw_text"))
    kept = lines.where("raw_text <> ''")
    return number_rows(kept, ["_block_start", "_seq"], ["file"], tie=[], out="line_number").select("file", "line_number", "raw_text")


def count_delimited_rows(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines minus one header per file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    per_file = lines.groupBy("file").agg((F.count(F.lit(1)) - 1).alias("n"))
    return per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"))


def preview(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows, each with the true number of rows of the table."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*order).limit(n).withColumn("row_count", total)


def file_facts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, size_bytes, fingerprint): SHA-256 of the bytes of each file, of any size.

    A hash takes its bytes in order, so a file is one task. Local and mounted files are read piece by piece in it. Those of another store are
    read by Spark, which only gives a file as one value: up to ``WHOLE_BYTES`` in the tasks, larger ones piece by piece on the driver, now.
    """
    @F.udf("string")
    def hashed(file):  # nested, so that it travels to the executors by value
        with open(file.removeprefix("file:"), "rb", buffering=0) as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    paths = {True: [], False: []}
    for p in [path] if isinstance(path, str) else path:
        paths[_hadoop_file(spark, p)[0].getUri().getScheme() == "file"].append(p)
    out = []
    facts = ["path", F.col("length").alias("size_bytes")]
    if paths[True]:
        out.append(spark.read.format("binaryFile").load(paths[True]).select(*facts, hashed("path").alias("fingerprint")))
    if paths[False]:
        files, small = spark.read.format("binaryFile").load(paths[False]), F.col("length") <= WHOLE_BYTES  # a file beyond it is not opened
        out.append(files.where(small).select(*facts, F.sha2("content", 256).alias("fingerprint")))
        if large := [r.path for r in files.where(~small).select("path").collect()]:
            out.append(_hashed_on_driver(spark, large))
    return reduce(DataFrame.unionByName, out)


def _hadoop_file(spark: SparkSession, path: str):
    """(file system, path) as Spark itself resolves them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _hashed_on_driver(spark: SparkSession, paths: list[str]) -> DataFrame:
    """File facts of ``paths``, read by the driver's JVM, a few files at a time."""
    digest = spark._jvm.org.apache.commons.codec.digest.DigestUtils

    def one(path: str) -> tuple[str, int, str]:
        fs, at = _hadoop_file(spark, path)
        stream = fs.open(at)
        try:
            return path, fs.getFileStatus(at).getLen(), digest.sha256Hex(stream)
        finally:
            stream.close()

    with ThreadPoolExecutor(4) as pool:
        return spark.createDataFrame(list(pool.map(one, paths)), "path string, size_bytes long, fingerprint string")


def folder_facts(files: DataFrame) -> DataFrame:
    """File facts folded to their folders: total size, and one fingerprint over the sorted fingerprints of the files."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    prints = F.array_sort(F.collect_list("fingerprint"))  # one folder's files
    return files.groupBy(parent.alias("path")).agg(F.sum("size_bytes").alias("size_bytes"), F.sha2(F.concat_ws(",", prints), 256).alias("fingerprint"))


def drifted(profiled: DataFrame, current: DataFrame, max_bytes: int | None = None, formats: list[str] | None = None) -> DataFrame:
    """(path, verdict, size_bytes, too_large, known_format) for every profiled path; the verdict is same, changed or missing.

    ``max_bytes`` and ``formats`` (file name endings) only fill their own columns; without them these are false and true.
    """
    now = current.select("path", F.col("fingerprint").alias("_now"), F.col("size_bytes").alias("_size"))
    verdict = (
        F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("fingerprint"), "same").otherwise("changed"))
    large = F.lit(False) if max_bytes is None else F.coalesce(F.col("_size") > max_bytes, F.lit(False))
    known = F.lit(True) if formats is None else F.lower(F.regexp_extract("path", r"([^./]+)$", 1)).isin([f.lower().lstrip(".") for f in formats])
    return profiled.join(now, "path", "left").select(
        "path", verdict.alias("verdict"), F.col("_size").alias("size_bytes"), large.alias("too_large"), known.alias("known_format"))


def read_job_table(spark: SparkSession, name: str, folder: str | None = None, jdbc: dict | None = None,
                   key: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """A job table from Parquet files, or over JDBC split on a numeric key into (low, high, parts)."""
    if folder:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    reader = spark.read.format("jdbc").options(dbtable=name, **(jdbc or {}))
    if key and bounds:
        low, high, parts = bounds
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


# -- records kept as JSON -------------------------------------------------------------------------------------------

def to_records(df: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """(key, record_index, payload): rows as JSON text, numbered from 1 within the key."""
    numbered = number_rows(df.select(key, *dict.fromkeys(order + payload)), order, [key], tie=[], out="record_index")
    return numbered.select(key, "record_index", F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("payload"))


def from_records(results: DataFrame, key: str, payload: str, record: str) -> DataFrame:
    """(key, record_index, fields…): the first usable list of records in each payload.

    ``cleaned_data`` first, then a complete ``cleaned_preview`` (a short one means the full data is elsewhere),
    then ``records``, ``rows``, ``data``. ``record`` is the schema of one record; private fields stay out of it.
    """
    lists = ("cleaned_data", "cleaned_preview", "records", "rows", "data")
    schema = ", ".join([*(f"{c} array<struct<{record}>>" for c in lists), "record_count string"])
    parsed = results.select(key, F.from_json(payload, schema).alias("_p"))

    def some(name) -> Column:
        return F.size(F.coalesce(F.col(f"_p.{name}"), F.array().cast(f"array<struct<{record}>>"))) > 0

    expected = F.coalesce(F.col("_p.record_count").try_cast("int"), F.lit(0))
    chosen = (
        F.when(some("cleaned_data"), F.col("_p.cleaned_data"))
        .when(some("cleaned_preview") & (expected > F.size("_p.cleaned_preview")), F.lit(None))
        .when(some("cleaned_preview"), F.col("_p.cleaned_preview"))
        .when(some("records"), F.col("_p.records")).when(some("rows"), F.col("_p.rows")).otherwise(F.col("_p.data")))
    rows = parsed.select(key, F.posexplode(chosen).alias("_pos", "_r"))
    return rows.select(key, (F.col("_pos") + 1).cast("bigint").alias("record_index"), "_r.*")


def shape_audit(*entries: DataFrame) -> DataFrame:
    """Union of audit entries by name; nested values as JSON text; step_kind from the origin."""
    flat = []
    for e in entries:
        nested = {c: F.to_json(c) for c, t in e.dtypes if t.startswith(("array", "struct", "map"))}
        flat.append(e.withColumns(nested))
    out = flat[0]
    for e in flat[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    kind = F.when(F.lower(F.coalesce(F.col("origin"), F.lit(""))) == "filter_prep", "internal_preparation").otherwise("user_requested")
    return out.select(kind.alias("step_kind"), *[c for c in out.columns if c != "step_kind"])
