"""Folders of TXT, JSON and (with an adapter) PDF files as documents; summaries and fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import sized, written

#: Bytes of the largest file that is read; a larger one, which no row can hold, is a row with an error.
LARGEST_FILE = 2_000_000_000
#: What Python's ``str.strip`` takes off.
_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_DOC = ["file", "item_index", "id", "title", "content", "error"]


def _files(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """(file, stem, length, content) of the files right in ``folder``; of one kind, where other files are left out when the folder is listed. Without ``content`` in what is selected, no file is opened."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        raise FileNotFoundError(folder)
    alike = system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, "*=*"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(any(f.isDirectory() for f in alike)).lower())  # else files beside a folder named like a partition aren't listed
    if kind:
        read = read.option("pathGlobFilter", "*." + "".join(f"[{c}{c.upper()}]" for c in kind))
    name = F.regexp_extract("path", "[^/]*$", 0)
    inside = F.regexp_replace("path", "/[^/]*$", "") == system.makeQualified(root).toString().rstrip("/")
    return read.load(folder).filter(inside).select(name.alias("file"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length", "content")


def _fields(item: Column, stem: Column, index: Column | None) -> dict[str, Column]:
    """id, title and content of a JSON object by the first key that isn't empty."""
    get = lambda k: _truthy(F.try_variant_get(item, f"$.{k}", "variant"))
    first = lambda *keys: F.coalesce(*map(get, keys))
    numbered = lambda name: F.concat_ws("_", name, index.cast("string")) if index is not None else name
    return {"id": F.coalesce(get("id"), numbered(T.slugify(stem))), "title": F.coalesce(first("title", "name", "titre"), numbered(stem)), "content": F.coalesce(first("content", "text", "texte", "body"), F.lit(""))}


def json_items(rows: DataFrame, column: str = "json", stem: str = "stem") -> DataFrame:
    """The objects in each row's JSON text, an array of them or one object: the row's columns but ``column``, with item_index, id, title, content and error.

    ``item_index`` is the place in the array, others than objects counted (but dropped, as are roots of another kind).
    Keys are taken as in ``json_documents``, with the column ``stem`` and the number where they are missing. A text that isn't JSON, or has
    more after it, is a row with its error; so is one in which an object repeats a key or is over 128 MB large. A null text gives no row.
    Values are written as JSON writes them, numbers without a fraction of zeros. Parsed in the JVM, each object as a value of its own.
    """
    whole, first = F.concat(F.lit("["), F.col(column), F.lit("]")), F.left(F.ltrim(F.col(column), F.lit(" \t\n\r")), F.lit(1))
    one = F.transform(F.from_json(whole, "array<variant>"), lambda v: F.array(v))
    roots = F.when(first == "[", F.from_json(whole, "array<array<variant>>")).otherwise(one)  # a single root, or it isn't JSON
    others = [c for c in rows.columns if c not in {column, "item_index", "id", "title", "content", "error"}]
    held = rows.filter(F.col(column).isNotNull()).select(*others, roots.alias("__roots"))
    held = held.select(*others, F.when(F.size("__roots") == 1, F.get("__roots", F.lit(0))).alias("__items"))
    held = held.select(*others, F.when(F.col("__items").isNull(), F.lit("ValueError: not one JSON value")).alias("error"), F.posexplode_outer("__items").alias("item_index", "__item"))
    held = held.filter(F.col("error").isNotNull() | F.schema_of_variant("__item").startswith("OBJECT"))
    found = {k: F.when(F.col("error").isNull(), v).alias(k) for k, v in _fields(F.col("__item"), F.col(stem), F.col("item_index")).items()}
    return held.select(*others, "item_index", *found.values(), "error")


def unique_ids(docs: DataFrame, place: Sequence[str] = ("file", "item_index")) -> DataFrame:
    """``docs`` with no ``id`` twice: later ones, by ``place``, which tells rows apart and has no nulls where there is an id, get a number after two underscores. Rows without an id stay as they are.

    Only ids and places are shuffled and ranked, in ranges of (id, place), so that an id that most rows
    share is numbered by many tasks; texts meet the few new ids in a join. Where a new id is another's own, it is numbered again.
    """
    names, changed = docs.filter("id IS NOT NULL").select("id", *place), False
    names = written(names, "ids")
    while True:
        again = sized(names.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "ids-again")
        if again.table.isEmpty():
            break
        met = names.join(again.side(), "id", "left_semi")
        ranged = written(met.repartitionByRange("id", *place).withColumn("part", F.spark_partition_id()), "ids-ranged")
        before = ranged.groupBy("id", "part").agg(F.count("*").alias("n"))
        before = before.select("id", "part", F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        n = F.row_number().over(Window.partitionBy("id", "part").orderBy(*place)) + F.col("before")
        fresh = ranged.join(before, ["id", "part"]).select(F.when(n > 1, F.concat_ws("__", "id", n.cast("string"))).otherwise(F.col("id")).alias("id"), *place)
        names, changed = written(names.join(again.side(), "id", "left_anti").select("id", *place).unionByName(fresh), "ids"), True
    if not changed:
        return docs
    old = docs.filter("id IS NOT NULL").select(F.col("id").alias("old"), *place)
    new = sized(names.join(old, list(place)).filter("id != old").select(*place, F.col("id").alias("new")), "ids-new")
    return docs.join(new.side(), list(place), "left").withColumn("id", F.coalesce("new", "id")).select(*docs.columns)


def load_folder(spark: SparkSession, folder: str, pdf: Callable[[bytes], str] | None = None, clean_pdf: bool = True, ordered: bool = True) -> DataFrame:
    """(file, item_index, id, title, content, error) of the .txt, .json and .pdf files right in ``folder``; FileNotFoundError where there is none.

    ``item_index`` is an object's place in its JSON file, else 0. Other files are rows with neither id nor error, which ``folder_summary``
    counts as skipped; they are never opened. A file that can't be decoded, or is over LARGEST_FILE, is a row with its error. Repeated ids get a
    number in file order (``unique_ids``). ``pdf`` extracts a PDF's text, which is cleaned as the others aren't; it runs once, into a table in the shared folder, and is all that runs in Python.
    Empty files and those whose names begin with a dot or an underscore are not seen, as Spark's readers have it. ``ordered`` sorts rows by file and place, which moves all texts.
    """
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    fits = F.col("length") <= LARGEST_FILE  # the scan leaves others closed
    read = lambda kind: _files(spark, folder, kind).filter(fits)
    text = F.make_valid_utf8(F.col("content").cast("string"))

    def extract(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time
                said = error = None
                try:
                    if pdf is None:
                        raise ImportError("no PDF text extractor was given")
                    said = pdf(batch.column(2)[i].as_py())
                except Exception as e:  # one bad file must not end the load: it becomes a row with its error
                    error = f"{type(e).__name__}: {e}"
                yield pa.record_batch([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([said], pa.string()), pa.array([error], pa.string())], names=["file", "stem", "content", "error"])

    plain = read("txt").select("file", F.lit(0).alias("item_index"), T.slugify(F.col("stem")).alias("id"), F.col("stem").alias("title"), F.trim(text, F.lit(_SPACE)).alias("content"), *none("error"))
    items = json_items(read("json").select("file", "stem", text.alias("json"))).select(*_DOC)
    shown = written(read("pdf").select("file", "stem", "content").mapInArrow(extract, "file string, stem string, content string, error string"), "pdf-texts")
    good = F.col("error").isNull()
    shown = shown.select("file", F.lit(0).alias("item_index"), F.when(good, T.slugify(F.col("stem"))).alias("id"), F.when(good, F.col("stem")).alias("title"), (T.clean(F.col("content")) if clean_pdf else F.col("content")).alias("content"), "error")
    every, known = _files(spark, folder), F.lower("file").rlike(r"\.(txt|json|pdf)$")
    rest = every.filter(~known | ~fits).select("file", F.lit(0).alias("item_index"), *none("id", "title", "content"), F.when(known, F.concat_ws(" ", F.lit("ValueError: file of"), F.col("length").cast("string"), F.lit("bytes"))).alias("error"))
    docs = unique_ids(plain.unionByName(items).unionByName(shown)).unionByName(rest)
    return docs.orderBy("file", "item_index") if ordered else docs


def folder_summary(loaded: DataFrame) -> DataFrame:
    """(n_docs, n_words, words_per_doc, n_skipped, n_errors, errors) of ``load_folder``."""
    held = loaded.filter("id IS NOT NULL").withColumn("text", F.col("content"))
    rest = loaded.agg(F.count(F.when(F.col("id").isNull() & F.col("error").isNull(), 1)).alias("n_skipped"), F.count("error").alias("n_errors"), F.sort_array(F.collect_list(F.concat_ws(": ", F.when(F.col("error").isNotNull(), F.col("file")), "error"))).alias("errors"))
    return load_summary(held).crossJoin(rest.withColumn("errors", F.filter("errors", lambda x: x != "")))  # one row each


def export_text(docs: DataFrame, path: str, text: str = "content") -> None:
    """Writes the texts as text files."""
    docs.filter(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("value")).write.text(path)


def _truthy(value: Column) -> Column:
    """A variant as a string, or null where it is empty: "", 0, false, null, [] or {}."""
    kind, said = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    empty = F.when(kind == "STRING", said == "").when(kind == "BOOLEAN", said == "false").when(kind.startswith("ARRAY"), said == "[]").when(kind.startswith("OBJECT"), said == "{}").when(kind == "VOID", True).otherwise(F.coalesce(number == 0, F.lit(False)))
    return F.when(value.isNotNull() & ~empty, F.when(kind == "BOOLEAN", F.initcap(said)).otherwise(said))


def json_documents(rows: DataFrame, column: str = "json", stem: str = "document", index: str | None = None) -> DataFrame:
    """id, title and content of JSON objects in a column, by the first key that isn't empty (in JSON: "", 0, false, null, [] and {} are). Without an id, title or content: a slug of ``stem``, ``stem``, and the empty text; where there is a column ``index``, id and title end in its number, as items of one file do."""
    return rows.withColumns(_fields(F.try_parse_json(column), F.lit(stem), F.col(index) if index else None))


def load_summary(docs: DataFrame, text: str = "text") -> DataFrame:
    n = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size(T.words(F.coalesce(F.col(text), F.lit(""))))), F.lit(0)).cast("long").alias("n_words"))
    return n.withColumn("words_per_doc", F.expr("n_words div greatest(n_docs, 1)"))


def corpus_fingerprint(docs: DataFrame, config: str = "{}", key: str = "doc_id", text: str = "text", chars: int | None = None) -> DataFrame:
    """Twelve hexadecimal digits for ids, whole texts and configuration, in whatever order rows come. Every document is digested by itself, and the digests are summed up, so partial sums combine in each task; ``chars`` digests only so many first characters, as a cheap variant."""
    body = F.left(F.col(text), F.lit(chars)) if chars else F.col(text)
    one = docs.select(F.sha2(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(body, F.lit(""))), 256).alias("h"))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(28,0)")), F.lit(0)).cast("string")
    return one.agg(F.left(F.sha2(F.concat_ws("|", part(1), part(16), part(31), F.lit(config)), 256), F.lit(12)).alias("fingerprint"))
