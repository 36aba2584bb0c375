"""Command line: analyze, profile, compare, source, cadence. Paths may be globs that Spark reads."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.operators import cadence, lookup, measures, profiles
from lexigrain.plans.registry import STOP
from lexigrain.session import local_session
from lexigrain.sources import readers, sinks
from lexigrain.storage import Scratch


def properties(docs: DataFrame) -> DataFrame:
    """All row-local properties of (doc_id, text), wide."""
    return measures.properties(docs, STOP)


#: Counts measure how much was written, not how; profiles leave them out.
COUNTS = ["n_tokens", "n_types", "n_sentences", "n_paragraphs", "text_length", "word_count"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexigrain")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("analyze", "profile", "cadence"):
        sub.add_parser(name).add_argument("files", nargs="+")
    for name, second in (("compare", "profile"), ("source", "target")):
        p = sub.add_parser(name)
        p.add_argument("file")
        p.add_argument(second)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    show = lambda df: [print(r[0]) for r in df.select(F.to_json(F.struct("*"))).toLocalIterator()]
    if args.command == "analyze":
        show(properties(readers.text_files(spark, *args.files)))
    elif args.command == "profile":
        values = profiles.long(properties(readers.text_files(spark, *args.files)).drop(*COUNTS), ["doc_id"])
        print(sinks.profile_document(profiles.profile(values, [])).first()[0])
    elif args.command == "cadence":
        docs = readers.text_files(spark, *args.files)
        show(cadence.sentences(docs))
        show(cadence.patterns(docs))
    elif args.command == "compare":
        values = profiles.long(properties(readers.text_files(spark, args.file)).drop(*COUNTS), ["doc_id"])
        flags = profiles.compare(values, readers.profile_json(spark, args.profile), []).orderBy(F.desc("spans"), "property")
        show(flags)
        return 0 if flags.isEmpty() else 1
    else:
        docs = readers.text_files(spark, args.file, args.target)
        lists = Scratch(spark, "source").table(lookup.gram_lists(docs), "lists")
        ids = {r.path: r.doc_id for r in docs.select("path", "doc_id").collect()}  # two files
        one, two = (next(i for p, i in ids.items() if p.endswith(f.rsplit("/", 1)[-1])) for f in (args.file, args.target))
        pairs = spark.createDataFrame([(one, two)], "source long, target long")
        empty = spark.createDataFrame([], "variant string, item string, per_million double")
        rows = lookup.source_comparison(pairs, lists, empty).select("variant", "share").collect()  # 23 rows
        print(json.dumps({r.variant: r.share for r in sorted(rows, key=lambda r: r.variant)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
