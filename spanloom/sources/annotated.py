"""Readers of annotated corpora: column formats, bracketed trees, sparse vectors, triples, cluster paths, frames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.operators.rejects import CONLLU_COLUMNS
from spanloom.session import cut, small

CONLLX_COLUMNS = ("id", "form", "lemma", "cpos", "pos", "feats", "head", "deprel", "phead", "pdeprel")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, sent, value: the blocks of a file between blank lines, numbered from 0 in their file.

    An empty line ends a row for the reader, so a large file is read by as many tasks as it has splits; blank lines of other
    forms (with blanks or carriage returns) part a row afterwards. A block's number is its place in its split and the blocks of
    the splits before.
    """
    text = spark.read.option("lineSep", "\n\n").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r", "").alias("value"))
    parts = F.filter(F.split("value", "\n[ \t]*\n+"), lambda b: F.regexp_replace(b, r"\s", "") != "")
    rows = cut(rows.select("file", "split", "id", F.posexplode(parts).alias("at", "value")), "blocks")
    sizes = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("file", "split", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = F.broadcast(before) if small(before) else before
    here = F.row_number().over(Window.partitionBy("file", "split").orderBy("id", "at")) - 1
    return rows.withColumn("here", here).join(before, ["file", "split"]).select("file", (F.col("before") + F.col("here")).cast("int").alias("sent"), "value")


def _columns(blocks: DataFrame, names: tuple[str, ...]) -> DataFrame:
    rows = blocks.select("file", "sent", F.posexplode(F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#") & (F.trim(x) != ""))).alias("tok", "line"))
    cells = F.split("line", "\t", -1)
    out = rows.select("file", "sent", "tok", cells.alias("c"), "line")
    return out.select("file", "sent", "tok", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)], F.when(F.size("c") != len(names), F.col("line")).alias("_corrupt"))


def conllx(spark: SparkSession, path: str) -> DataFrame:
    """file, sent, tok (from 0), the ten columns, head_index (0-based, null at the root), _corrupt."""
    df = _columns(_blocks(spark, path), CONLLX_COLUMNS)
    ok = F.col("id").try_cast("int") == F.col("tok") + 1
    head = F.col("head").try_cast("int")
    return df.withColumn("head_index", F.when(head > 0, head - 1)).withColumn("_corrupt", F.coalesce("_corrupt", F.when(~F.coalesce(ok, F.lit(False)), F.lit("id"))))


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """file, sent, tok, the ten columns, feats_map, _corrupt."""
    df = _columns(_blocks(spark, path), CONLLU_COLUMNS)
    return df.withColumn("feats_map", F.when(F.col("feats").isNotNull() & ~F.col("feats").isin("_", ""), F.str_to_map("feats", F.lit(r"\|"), F.lit("="))))


def dependency_edges(words: DataFrame, wall: bool = False) -> DataFrame:
    """file, sent, parent, child, label, 0-based (S12, S14): edges from the root are left out, or come from node n, the wall."""
    if wall:
        n = words.groupBy("file", "sent").agg(F.count("*").alias("n"))
        return words.join(n, ["file", "sent"]).select("file", "sent", F.coalesce("head_index", "n").alias("parent"), F.col("tok").alias("child"), F.col("deprel").alias("label"))
    return words.filter("head_index is not null").select("file", "sent", F.col("head_index").alias("parent"), F.col("tok").alias("child"), F.col("deprel").alias("label"))


def parse_brackets(text: str) -> list[dict]:
    """Nodes of bracketed trees in the order of their open brackets: id, parent, start, end, category, word, first_leaf, last_leaf."""
    nodes: list[dict] = []
    stack: list[int] = []
    i, leaf, n = 0, 0, len(text)
    while i < n:
        ch = text[i]
        if ch == "(":
            nodes.append({"id": len(nodes), "parent": stack[-1] if stack else None, "start": i, "end": None, "category": None, "word": None, "first_leaf": None, "last_leaf": None})
            stack.append(len(nodes) - 1)
            i += 1
        elif ch == ")":
            if not stack:
                raise ValueError(f"bracket without partner at {i}")
            at = nodes[stack.pop()]
            at["end"] = i + 1
            i += 1
        elif ch.isspace():
            i += 1
        else:
            j = i
            while j < n and not text[j].isspace() and text[j] not in "()":
                j += 1
            token, i = text[i:j], j
            if not stack:
                raise ValueError(f"text outside brackets at {i}")
            node = nodes[stack[-1]]
            if node["category"] is None and node["word"] is None and node["end"] is None and text[node["start"] + 1 : i - len(token)].strip() == "":
                node["category"] = token
            else:
                node["word"] = token if node["word"] is None else f"{node['word']} {token}"
                if node["first_leaf"] is None:
                    for k in stack:
                        nodes[k]["first_leaf"] = leaf if nodes[k]["first_leaf"] is None else nodes[k]["first_leaf"]
                        nodes[k]["last_leaf"] = leaf
                    leaf += 1
    if stack:
        raise ValueError("bracket left open")
    return nodes


_NODE = "array<struct<id:int,parent:int,start:int,end:int,category:string,word:string,first_leaf:int,last_leaf:int>>"


def brackets(df: DataFrame, key: str, text: str, skip: tuple[str, ...] = ("EDITED",), traces: tuple[str, ...] = ("-NONE-",)) -> DataFrame:
    """key, node columns, is_trace, skipped, _corrupt: one row per tree node of a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees, bad = [], []
            for t in b.column(1).to_pylist():
                try:
                    trees.append(parse_brackets(t) if t else [])
                    bad.append(None)
                except ValueError as e:
                    trees.append([])
                    bad.append(str(e))
            node = pa.struct([("id", pa.int32()), ("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("word", pa.string()), ("first_leaf", pa.int32()), ("last_leaf", pa.int32())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees, pa.list_(node)), pa.array(bad, pa.string())], names=["key", "nodes", "_corrupt"])

    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = src.mapInArrow(run, f"key {dict(src.dtypes)['key']}, nodes {_NODE}, _corrupt string")
    flat = out.select("key", F.explode_outer("nodes").alias("n"), "_corrupt").select("key", "n.*", "_corrupt").filter("id is not null or _corrupt is not null")
    return flat.withColumn("is_trace", F.col("category").isin(*traces)).withColumn("skipped", F.col("category").isin(*skip)).withColumnRenamed("key", key)


def svmlight(spark: SparkSession, path: str) -> DataFrame:
    """y, indices, vals, comment, _corrupt of lines `+1 3:0.5 ... # comment`; labels must be +1 or -1; indices stay as written."""
    comment = F.when(F.instr("value", "#") > 0, F.trim(F.regexp_replace("value", "^[^#]*#", "")))
    body = F.split(F.trim(F.substring_index("value", "#", 1)), r"\s+")
    df = spark.read.text(path).filter(F.trim("value") != "").select("value", comment.alias("comment"), body.alias("f"))
    cells = F.filter(F.slice("f", 2, F.greatest(F.size("f"), F.lit(1))), lambda x: x != "")
    ok = F.get("f", F.lit(0)).rlike(r"^[+-]?1(\.0*)?$") & F.forall(cells, lambda x: x.rlike(r"^[0-9]+:[-+0-9.eE]+$"))
    at = lambda k: F.when(ok, F.transform(cells, lambda x: F.get(F.split(x, ":"), F.lit(k)).try_cast("int" if k == 0 else "double")))
    return df.select(F.when(ok, F.get("f", F.lit(0)).try_cast("double") > 0).alias("y"), at(0).alias("indices"), at(1).alias("vals"), "comment", F.when(~ok, F.col("value")).alias("_corrupt"))


def svmlight_lines(df: DataFrame, one_based: bool = True) -> DataFrame:
    """value: the inverse of svmlight (K5); one_based adds 1 to the indices."""
    cells = F.zip_with("indices", "vals", lambda i, v: F.concat((i + (1 if one_based else 0)).cast("string"), F.lit(":"), v.cast("string")))
    tail = F.when(F.col("comment").isNotNull(), F.concat(F.lit("\t# "), F.col("comment"))).otherwise("")
    return df.select(F.concat(F.when(F.col("y"), "+1").otherwise("-1"), F.lit(" "), F.array_join(cells, " "), tail).alias("value"))


def _token(c: Column) -> Column:
    kind = (
        F.when(c.rlike("^<.*>$"), "entity").when(c.rlike(r'^".*"\^\^<.*[iI]nteger>$'), "integer").when(c.rlike(r'^".*"\^\^<.*date>$'), "date")
        .when(c.rlike('^".*"@en$'), "string").otherwise("other")
    )
    value = F.when(kind == "entity", F.regexp_replace(c, "^<|>$", "")).otherwise(F.regexp_extract(c, '^"(.*)"', 1))
    return F.struct(kind.alias("type"), F.when(kind == "other", c).otherwise(value).alias("value"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o as (type, value), valid; comments and blank lines are skipped; a line is valid if a full stop is all that follows."""
    term = r'(<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?|\S+)'
    pattern = rf"^\s*{term}\s+{term}\s+{term}\s*(.*?)\s*$"
    df = spark.read.text(path).filter(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    part = lambda i: F.regexp_extract("value", pattern, i)
    return df.select(*[_token(part(i)).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"))], (part(4) == ".").alias("valid"))


def skipped_share(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.avg(F.when(F.col("valid"), 0.0).otherwise(1.0)).alias("skipped"))


def machine_id(c: Column) -> Column:
    """`.../ns/m.X` -> `/m/X`."""
    x = F.regexp_extract(c, r"/ns/m\.([^/>\s]+)", 1)
    return F.when(x != "", F.concat(F.lit("/m/"), x))


def is_knowledge_node(c: Column) -> Column:
    return c.startswith("http://")


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, vec of a text file whose first line is `V dim`; rows that haven't dim numbers are left out."""
    rows = spark.read.text(path).select(F.filter(F.split("value", " "), lambda x: x != "").alias("f"), F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_block_start").alias("block"))
    head = rows.filter("block = 0").agg(F.min_by("f", "id").alias("f"), F.min("id").alias("id")).head()
    if head["f"] is None:
        return rows.select(F.lit("").alias("word"), F.array().cast("array<float>").alias("vec")).limit(0)
    numbers = F.transform(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), lambda x: x.try_cast("float"))
    body = rows.filter((F.col("id") != head["id"]) & (F.size("f") == int(head["f"][1]) + 1)).select(F.get("f", F.lit(0)).alias("word"), numbers.alias("vec"))
    return body.filter(F.forall("vec", lambda x: x.isNotNull()))


def cluster_paths(spark: SparkSession, path: str, min_count: int = 3) -> DataFrame:
    """bit_path, word, frequency of at least min_count."""
    return spark.read.schema("bit_path string, word string, frequency bigint").option("sep", "\t").option("quote", "").csv(path).filter(F.col("frequency") >= min_count)


def cluster_of(words: DataFrame, paths: DataFrame, word: str, lengths: tuple[int, ...] = ()) -> DataFrame:
    """words with `cluster`: the bit path, `???` if unknown, and its prefixes."""
    out = words.join(paths.select(F.col("word").alias(word), F.col("bit_path").alias("cluster")), word, "left").withColumn("cluster", F.coalesce("cluster", F.lit("???")))
    return out.select("*", *[F.substring("cluster", 1, n).alias(f"cluster_{n}") for n in lengths])


FRAME_SCHEMA = T.StructType([
    T.StructField("_lemma", T.StringType()),
    T.StructField("roleset", T.ArrayType(T.StructType([
        T.StructField("_id", T.StringType()), T.StructField("_name", T.StringType()), T.StructField("_vncls", T.StringType()),
        T.StructField("roles", T.StructType([T.StructField("role", T.ArrayType(T.StructType([
            T.StructField("_n", T.StringType()), T.StructField("_f", T.StringType()), T.StructField("_descr", T.StringType()),
            T.StructField("vnrole", T.ArrayType(T.StructType([T.StructField("_vncls", T.StringType()), T.StructField("_vntheta", T.StringType())]))),
        ])))])),
    ]))),
])

#: Modifier roles of frames.
MODIFIER_ROLES = ("ADV", "CAU", "DIR", "DIS", "EXT", "LOC", "MNR", "MOD", "NEG", "PNC", "PRD", "REC", "TMP")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """file, lemma, id, name, vncls, roles of frame files (S21); roles without a number are skipped; a frame id given twice is an error."""
    df = spark.read.format("xml").option("rowTag", "predicate").schema(FRAME_SCHEMA).load(path)
    df = df.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1).alias("file"), F.col("_lemma").alias("lemma"), F.explode("roleset").alias("r"))
    role = lambda x: F.struct(x["_n"].alias("role"), x["_f"].alias("feature"), x["_descr"].alias("description"), x["vnrole"].alias("vnroles"))
    out = df.select("file", "lemma", F.col("r._id").alias("id"), F.col("r._name").alias("name"), F.col("r._vncls").alias("vncls"), F.transform(F.filter("r.roles.role", lambda x: x["_n"].isNotNull() & (x["_n"] != "")), role).alias("roles"))
    twice = out.groupBy("id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"frame {twice[0]['id']} is there twice")
    return out


def mentions(df: DataFrame, key: str, line: str = "value") -> DataFrame:
    """key, ord, mid, first, end of lines `(<mid> <start>-<end>)*`, end exclusive; /m/ is taken off the id."""
    found = F.regexp_extract_all(line, F.lit(r"\S+\s+[0-9]+-[0-9]+"), F.lit(0))
    out = df.select(key, F.posexplode(found).alias("ord", "m"))
    span = F.regexp_extract("m", r"([0-9]+)-([0-9]+)$", 1), F.regexp_extract("m", r"([0-9]+)-([0-9]+)$", 2)
    return out.select(key, "ord", F.regexp_replace(F.substring_index("m", " ", 1), "^/m/", "").alias("mid"), span[0].cast("int").alias("first"), span[1].cast("int").alias("end"))


def tool_rows(df: DataFrame, tool: str, column: str = "tool") -> DataFrame:
    """The annotations of one tool of a document table in which each document must have exactly one."""
    out = df.filter(F.col(column) == tool)
    bad = df.select("doc_id").distinct().join(out.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").filter("coalesce(n, 0) <> 1").limit(1).collect()
    if bad:
        raise ValueError(f"document {bad[0]['doc_id']} hasn't exactly one annotation of {tool}")
    return out
