"""Plain lines, pairs, counts, whole files and their writers. Compression follows the suffix; schemas are explicit."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value: text lines; .gz and .bz2 by suffix (S1, S2). A missing path is an error."""
    return spark.read.text(path)


def doubles(spark: SparkSession, path: str) -> DataFrame:
    """value: one number a line; what isn't a number is null (S3)."""
    return lines(spark, path).select(F.trim("value").try_cast("double").alias("value"))


def pairs(spark: SparkSession, path: str, key_first: bool = True, unique: bool = False) -> DataFrame:
    """key, value of lines with one tab; what follows the first tab is one field (S4). unique makes a repeated key an error."""
    has = F.col("value").contains("\t")
    a = F.substring_index("value", "\t", 1)
    b = F.regexp_replace("value", "^[^\t]*\t", "")
    out = lines(spark, path).filter(has).select((a if key_first else b).alias("key"), (b if key_first else a).alias("value"))
    if unique:
        twice = out.groupBy("key").count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"key {twice[0]['key']!r} is there more than once")
    return out


def counted_names(spark: SparkSession, path: str) -> DataFrame:
    """name, n of lines like `  12 some name`."""
    pattern = r"^\s*([0-9]+)\s+(.*?)\s*$"
    return lines(spark, path).filter(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 2).alias("name"), F.regexp_extract("value", pattern, 1).cast("bigint").alias("n"))


def whole(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """path, value: each file as one text, line ends perhaps as blanks."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return df.withColumn("value", F.translate("value", "\r\n", "  ")) if one_line else df


def contents(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content: files as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def find(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, length of the files below root whose name matches (S8, S9); contents aren't read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", "length")


def with_ordinals(df: DataFrame, path_col: str | None = None) -> DataFrame:
    """Lines of one file with their number from 0 (for readers that zip files): line order within a file is kept by reading it whole."""
    return df.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n", -1)).alias("ord", "value"))


def write_lines(df: DataFrame, path: str, compression: str | None = None, append: bool = False) -> None:
    """One text column as lines; gzip or bzip2 (K1)."""
    w = df.write.mode("append" if append else "errorifexists")
    (w.option("compression", compression) if compression else w).text(path)


def write_pairs(df: DataFrame, path: str, append: bool = False) -> None:
    """Columns as tab-separated lines (K3, K4)."""
    write_lines(df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in df.columns])), path, append=append)


def document_frequencies(spark: SparkSession, paths: list[str]) -> DataFrame:
    """term, df, n_docs of saved tables whose first line is the number of documents; several tables add."""
    total, out = 0, None
    for p in paths:
        rows = whole(spark, p).transform(with_ordinals)
        total += int(rows.filter("ord = 0").head()["value"])
        t = rows.filter("ord > 0 and value like '%\t%'").select(F.substring_index("value", "\t", 1).alias("term"), F.substring_index("value", "\t", -1).cast("bigint").alias("df"))
        out = t if out is None else out.unionByName(t)
    return out.groupBy("term").agg(F.sum("df").alias("df")).withColumn("n_docs", F.lit(total).cast("bigint"))


def write_document_frequencies(df: DataFrame, n_docs: int, path: str) -> None:
    """The inverse: one file, the number of documents first (K3)."""
    head = df.sparkSession.createDataFrame([(0, str(n_docs))], "o int, value string")
    body = df.select(F.lit(1).alias("o"), F.concat_ws("\t", "term", F.col("df").cast("string")).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("o", "value").select("value").write.text(path)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """space, id, value; NULL is null; ids of a space must be dense from 0."""
    out = lines(spark, path).select(F.split("value", "\t").alias("f")).select(
        F.get("f", F.lit(0)).alias("space"), F.get("f", F.lit(1)).cast("bigint").alias("id"), F.when(F.get("f", F.lit(2)) != "NULL", F.get("f", F.lit(2))).alias("value")
    )
    bad = out.groupBy("space").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count_distinct("id").alias("n"), F.count("*").alias("c")).filter("lo <> 0 or hi + 1 <> n or n <> c").limit(1).collect()
    if bad:
        raise ValueError(f"ids of {bad[0]['space']!r} aren't dense")
    return out


def index_words(spark: SparkSession, path: str) -> DataFrame:
    """word, pos of lexicon index files named index.<pos>; comment lines begin with a blank."""
    df = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"index\.(\w+)", 1).alias("pos"))
    return df.filter(~F.col("value").startswith(" ")).select(F.substring_index("value", " ", 1).alias("word"), "pos").distinct()


def labelled_keys(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """label, left, right of lines `<label> key:a/b/c ...`: the parts of two chosen keys; other keys are skipped."""
    f = F.split(F.trim("value"), r"\s+")
    part = lambda k: F.get(F.transform(F.filter("f", lambda x: F.substring_index(x, ":", 1) == k), lambda x: F.split(F.regexp_replace(x, "^[^:]*:", ""), "/")), F.lit(0))
    return lines(spark, path).select(f.alias("f")).select(F.get("f", F.lit(0)).alias("label"), part(left).alias("left"), part(right).alias("right"))


def cached(wanted: DataFrame, path: str, key: str, compute, shards: int = 16) -> DataFrame:
    """key and computed columns for all wanted keys: what the cache at `path` lacks is computed and appended.

    The cache is Parquet partitioned by shard of the key, so a lookup of few keys prunes the other shards; compute takes and
    returns a DataFrame with the key.
    """
    spark = wanted.sparkSession
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard")
    keys = wanted.select(key).distinct()
    try:
        known = spark.read.parquet(path)
        missing = keys.join(known.select(key), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        missing = keys
    if not missing.isEmpty():
        compute(missing).select("*", shard).write.mode("append").partitionBy("shard").parquet(path)
    return spark.read.parquet(path).join(keys, key, "left_semi").drop("shard")


def rehash(spark: SparkSession, path: str, to: str, key: str, shards: int) -> None:
    """The cache rewritten with another number of shards."""
    df = spark.read.parquet(path).drop("shard").withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    df.repartition("shard").write.partitionBy("shard").parquet(to)
