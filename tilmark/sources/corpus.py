"""The verse corpus: JSON documents in, one flat table out.

Canonical table: idx, surah, ayah, plain (normal form), original. idx is the order of first appearance, which decides ties.
Two documents are read: the nested map {surah: {ayah: {"text": ...}}} and the service's document
{"data": {"surahs": [{"number", "ayahs": [{"numberInSurah", "text"}]}]}}.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilmark.functions.text import normalise, strip_end_of_ayah
from tilmark.plans import one_file, store

NESTED = "map<string,map<string,struct<text:string>>>"
SERVICE = "struct<data:struct<surahs:array<struct<number:int,ayahs:array<struct<numberInSurah:int,text:string>>>>>>"
SCHEMA = "idx long, surah int, ayah int, plain string, original string"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents as rows (document string)."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("document"))


def flatten_nested(documents: DataFrame, column: str = "document") -> DataFrame:
    """(surah_pos, ayah_pos, surah, ayah, original) of nested maps. A repeated key keeps its first place and its last
    value, as JSON objects do."""
    outer = documents.select(F.posexplode(F.from_json(F.col(column), NESTED)).alias("pos", "surah", "ayahs"))
    outer = outer.groupBy("surah").agg(F.min("pos").alias("surah_pos"), F.max_by("ayahs", "pos").alias("ayahs"))
    inner = outer.select("surah_pos", "surah", F.posexplode("ayahs").alias("pos", "ayah", "content"))
    return inner.groupBy("surah_pos", "surah", "ayah").agg(F.min("pos").alias("ayah_pos"), F.max_by(F.col("content.text"), "pos").alias("original")).select("surah_pos", "ayah_pos", F.col("surah").cast("int").alias("surah"), F.col("ayah").cast("int").alias("ayah"), "original")


def nested_text(document: Column | str, surah: Column, ayah: Column) -> Column:
    """The text under two keys of a nested document, or null."""
    ayahs = F.try_element_at(F.from_json(document, NESTED), surah.cast("string"))
    return F.try_element_at(ayahs, ayah.cast("string"))["text"]


def service_surahs(documents: DataFrame, column: str = "document") -> DataFrame:
    """(surah_pos, surah, ayahs) of service documents: of a repeated number the last list, at the first place. Missing
    lists count as empty; a missing number is an error."""
    parsed = F.from_json(F.col(column), SERVICE)
    each = documents.select(F.posexplode(F.coalesce(parsed["data"]["surahs"], F.array().cast("array<struct<number:int,ayahs:array<struct<numberInSurah:int,text:string>>>>"))).alias("pos", "s"))
    numbered = each.select("pos", F.coalesce(F.col("s.number"), F.raise_error(F.lit("surah without number")).cast("int")).alias("surah"), F.col("s.ayahs").alias("ayahs"))
    none = F.array().cast("array<struct<numberInSurah:int,text:string>>")
    return numbered.groupBy("surah").agg(F.min("pos").alias("surah_pos"), F.max_by(F.coalesce("ayahs", none), "pos").alias("ayahs"))


def parse_service(documents: DataFrame, column: str = "document") -> DataFrame:
    """The same columns of service documents; the end-of-ayah mark and outer white space are removed from texts."""
    each = service_surahs(documents, column).select("surah_pos", "surah", F.posexplode("ayahs").alias("pos", "a"))
    need = lambda c, what: F.coalesce(c, F.raise_error(F.lit(f"ayah without {what}")).cast("int" if what == "number" else "string"))
    named = each.select("surah_pos", "surah", "pos", need(F.col("a.numberInSurah"), "number").alias("ayah"), need(F.col("a.text"), "text").alias("text"))
    last = named.groupBy("surah_pos", "surah", "ayah").agg(F.min("pos").alias("ayah_pos"), F.max_by("text", "pos").alias("text"))
    return last.select("surah_pos", "ayah_pos", "surah", "ayah", strip_end_of_ayah("text").alias("original"))


def index(verses: DataFrame) -> DataFrame:
    """The canonical table of a flat corpus. A corpus is one document, so its order is a single sort of few rows."""
    order = Window.orderBy("surah_pos", "ayah_pos")
    return verses.select((F.row_number().over(order) - 1).cast("long").alias("idx"), "surah", "ayah", normalise("original").alias("plain"), "original")


def load_corpus(spark: SparkSession, table: str, document: str | None = None, url: str | None = None) -> DataFrame:
    """The stored table if there is one; else it is made from a document, or from a download, and stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    whole = jvm.org.apache.hadoop.fs.Path(f"{table}/_SUCCESS")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(whole):  # nothing there, or a write that broke off
        if document is not None:
            from tilmark.sources.corpus_scan import scan_nested

            verses = scan_nested(spark, document)
        elif url is not None:
            verses = parse_service(spark.createDataFrame([(download(url),)], "document string"))
        else:
            raise FileNotFoundError(f"no corpus at {table}, and no document or address to make it from")
        index(verses).coalesce(1).write.mode("overwrite").parquet(table)
    return spark.read.schema(SCHEMA).parquet(table)


def download(url: str, agent: str = "tilmark", seconds: float = 30) -> str:
    """A document over HTTP; any failure is a ConnectionError."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=seconds) as answer:
            return answer.read().decode("utf-8")
    except (urllib.error.URLError, TimeoutError) as error:
        raise ConnectionError(f"download of {url} failed: {error}") from error


def nested_json(corpus: DataFrame) -> DataFrame:
    """One row: the corpus as a nested JSON document, in index order."""
    verses = corpus.groupBy("surah").agg(F.min("idx").alias("first"), F.array_sort(F.collect_list(F.struct("idx", F.col("ayah").cast("string").alias("ayah"), F.struct(F.col("original").alias("text")).alias("content")))).alias("v"))
    entries = F.transform("v", lambda x: F.struct(x["ayah"].alias("ayah"), x["content"].alias("content")))
    named = verses.select("first", F.col("surah").cast("string").alias("surah"), entries.alias("ayahs"))
    whole = named.agg(F.array_sort(F.collect_list(F.struct("first", "surah", "ayahs"))).alias("s"))
    return whole.select(F.to_json(F.map_from_entries(F.transform("s", lambda x: F.struct(x["surah"], F.map_from_entries(x["ayahs"]))))).alias("value"))


def write_nested(verses: DataFrame, path: str) -> None:
    """Verses (surah, ayah, text) as one nested document in one file, a surah to a line, in order; of a repeated ayah the largest text is last. Ranges of surahs are made text by
    a task each, which holds a surah."""
    spark = verses.sparkSession
    entry = lambda key, value: F.concat(F.to_json(F.array(key.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(key.cast("string")))) - 2), F.lit(":"), value)
    ayahs = F.transform(F.array_sort(F.collect_list(F.struct("ayah", "text"))), lambda x: entry(x["ayah"], F.to_json(F.struct(x["text"].alias("text")))))
    lines = verses.groupBy("surah").agg(F.array_join(ayahs, ",").alias("v")).select("surah", entry(F.col("surah"), F.concat(F.lit("{"), "v", F.lit("}"))).alias("v"))
    first = verses.agg(F.min("surah").alias("first"))
    rows = lines.join(F.broadcast(first), F.lit(True)).select("surah", F.when(F.col("surah") == F.col("first"), F.col("v")).otherwise(F.concat(F.lit(","), "v")).alias("v"))
    store.delete(spark, path)
    with store.step():
        parts = one_file.sorted_bytes(rows, f"{path.rstrip('/')}/_parts", lambda values: "".join(f"{v}\n" for v in values.to_pylist()).encode())
        made = one_file.joined(parts, f"{path.rstrip('/')}/_whole", b"{\n", b"}\n")
    store.rename(spark, made, f"{path.rstrip('/')}/part-00000.txt")
    store.delete(spark, f"{path.rstrip('/')}/_parts")


def write_json(corpus: DataFrame, path: str, indent: int = 2) -> None:
    """Store a corpus as an indented JSON document."""
    spark = corpus.sparkSession
    text = json.dumps(json.loads(nested_json(corpus).first()["value"]), ensure_ascii=False, indent=indent)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def verse(corpus: DataFrame, surah: int, ayah: int) -> str | None:
    found = corpus.filter((F.col("surah") == surah) & (F.col("ayah") == ayah)).select("original").head()
    return found["original"] if found else None


def surah_verses(corpus: DataFrame, surah: int) -> DataFrame:
    found = corpus.filter(F.col("surah") == surah)
    if found.isEmpty():
        raise ValueError(f"surah {surah} is not in the corpus")
    return found.select("ayah", "original")


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """Surahs and ayahs of a flat corpus, which has no surahs without ayahs: counts of a document come from service_counts and nested_counts."""
    return corpus.agg(F.countDistinct("surah").alias("surahs"), F.count("*").alias("ayahs"))


def service_counts(documents: DataFrame, column: str = "document") -> DataFrame:
    """Surahs, also those without ayahs, and different ayahs of service documents."""
    numbers = F.array_distinct(F.transform("ayahs", lambda a: a["numberInSurah"]))
    return service_surahs(documents, column).agg(F.count("*").alias("surahs"), F.coalesce(F.sum(F.size(numbers)), F.lit(0)).cast("long").alias("ayahs"))


def nested_counts(documents: DataFrame, column: str = "document") -> DataFrame:
    """The same of nested documents."""
    outer = documents.select(F.posexplode(F.from_json(F.col(column), NESTED)).alias("pos", "surah", "ayahs"))
    last = outer.groupBy("surah").agg(F.max_by("ayahs", "pos").alias("ayahs"))
    return last.agg(F.count("*").alias("surahs"), F.coalesce(F.sum(F.size(F.array_distinct(F.map_keys("ayahs")))), F.lit(0)).cast("long").alias("ayahs"))
