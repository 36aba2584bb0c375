"""Sources: whole text files, JSON tables, web pages, treebanks. All are plans; nothing is read on the driver."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text is no prose.
SKIPPED = frozenset("script style nav footer aside figcaption head".split())


def text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, doc_id, text): one row for each whole file; doc_id is a hash of the path."""
    raw = spark.read.text(list(paths), wholetext=True)
    path = F.col("_metadata.file_path")
    return raw.select(path.alias("path"), F.xxhash64(path).alias("doc_id"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines, gzip included, with a declared schema: no inference pass."""
    return spark.read.schema(schema).json(path)


def profile_json(spark: SparkSession, path: str) -> DataFrame:
    """(property, samples, lo, med, hi) from a profile document {"samples", "range": {name: [lo, med, hi]}}."""
    raw = spark.read.schema("samples long, range map<string, array<double>>").option("multiLine", True).json(path)
    rows = raw.select("samples", F.explode("range").alias("property", "r"))
    return rows.select("property", "samples", *[F.col("r")[k].alias(n) for k, n in enumerate(("lo", "med", "hi"))])


class _Events(HTMLParser):
    """The tags and texts of a page in order: (+1 or -1, tag) and (0, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[int, str]] = []
        self.handle_starttag = lambda tag, attrs: self.events.append((1, tag))
        self.handle_endtag = lambda tag: self.events.append((-1, tag))
        self.handle_data = lambda data: self.events.append((0, data))


def paragraphs_of(html: str, least: int = 8) -> list[str]:
    """Paragraphs of at least ``least`` words; only an article's if it has three or more."""
    reader = _Events()
    reader.feed(html)
    reader.close()
    depth = {"skipped": 0, "article": 0}
    found: list[tuple[bool, list[str]]] = []  # of each paragraph: is it an article's; its words
    words: list[str] | None = None
    for step, value in [*reader.events, (-1, "p")]:
        kind = "skipped" if value in SKIPPED else value
        if step and kind in ("p", "article") and words is not None and (step, kind) != (1, "article"):
            found.append((depth["article"] > 0, "".join(words).split()))
            words = None
        if step and kind in depth:
            depth[kind] = max(0, depth[kind] + step)
        elif (step, kind) == (1, "p"):
            words = []
        elif not step and words is not None and not depth["skipped"]:
            words.append(value)
    long = [(own, " ".join(w)) for own, w in found if len(w) >= least]
    own = [text for inside, text in long if inside]
    return own if len(own) >= 3 else [text for _, text in long]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _paragraphs(pages: pa.Array) -> pa.Array:
    return pa.array([paragraphs_of(p or "") for p in pages.to_pylist()], pa.list_(pa.string()))


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, at, text) of the prose paragraphs of each page."""
    return pages.select("page_id", F.posexplode(_paragraphs("html")).alias("at", "text"))


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc, sent, at, form, lemma, upos, xpos, head, deprel): word lines of a treebank; ranges and empty nodes are left out.

    A file is one row and its lines are numbered inside it, so documents and
    sentences need a window over one file only.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    w = Window.partitionBy("path").orderBy("i")
    marked = files.withColumn("doc", F.sum(F.col("line").startswith("# newdoc").cast("int")).over(w)).withColumn("sent", F.sum((F.trim("line") == "").cast("int")).over(w))
    cells = marked.withColumn("c", F.split("line", "\t")).filter((F.size("c") >= 8) & F.col("c")[0].rlike("^[0-9]+$"))
    names = ("form", "lemma", "upos", "xpos")
    return cells.select("path", "doc", "sent", F.col("c")[0].cast("int").alias("at"), *[F.col("c")[k + 1].alias(n) for k, n in enumerate(names)], F.col("c")[6].cast("int").alias("head"), F.col("c")[7].alias("deprel"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec): a space in text form, a word and its numbers a line."""
    cells = spark.read.text(path).select(F.split("value", " ").alias("c")).filter(F.size("c") > 2)
    return cells.select(F.col("c")[0].alias("word"), F.transform(F.slice("c", 2, 1 << 30), lambda x: x.cast("float")).alias("vec"))
