"""Run the page pipeline from a shell: ``python -m pagelattice --tables DIR [--page N] [--final-stage NAME]``.

``--documents`` reads page files (needs the optional ``pymupdf``) instead of the test
tables' adapters. Prints the first ten words of the page and a line per stage.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagelattice.operators import scan
from pagelattice.plans import stages
from pagelattice.sources import documents, fixtures
from pagelattice.sources.sinks import configure_logging


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagelattice")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--documents", help="folder of page files")
    source.add_argument("--tables", help="folder of the test tables")
    p.add_argument("--page", type=int, default=0, help="page index")
    p.add_argument("--final-stage", choices=list(stages.STAGES), default=None)
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    configure_logging(args.verbose - args.quiet)
    spark = spark or SparkSession.builder.appName("pagelattice").getOrCreate()
    if args.documents:
        read = documents.read_pages(documents.list_documents(spark, args.documents), args.page)
        context = stages.Context(pages=read, words=documents.page_words(read), drawings=documents.page_drawings(read))
    else:
        pick = F.col("page_index") == args.page
        context = stages.Context(
            pages=scan.prune_pages(fixtures.page_meta(spark, args.tables), args.page),
            words=fixtures.words(spark, args.tables).where(pick),
            drawings=fixtures.raw_drawings(spark, args.tables).where(pick),
        )
    out = stages.run_stages(context, args.final_stage, materialize=True)
    for s in out:
        if s.key == "native" and s.status == "ok":
            head = [r.text for r in s.data.orderBy(*scan.page_keys(s.data), "seq").limit(10).collect()]
            print(f"{s.data.count()} words: {' '.join(head)}")
        print(f"{s.key}: {s.status}{f' ({s.error})' if s.error else ''}")
    return int(any(s.status == "error" for s in out))


if __name__ == "__main__":
    sys.exit(main())
