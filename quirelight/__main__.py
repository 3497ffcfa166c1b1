"""Batch recognition: ``python -m quirelight IN OUT --titles T --journals J --words W [--packed] [--form json]``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from quirelight.plans.recognize import recognize
from quirelight.sources import packed, registries, requests


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Reads payload files of a folder, recognises them and writes the results."""
    parser = argparse.ArgumentParser(prog="quirelight", description="Bibliographic metadata of page layouts.")
    parser.add_argument("payloads", help="folder of files, one request each, plain or gzip")
    parser.add_argument("out", help="folder of the results")
    for name, what in (("titles", "registered titles and DOIs"), ("journals", "journal names"), ("words", "counts of words")):
        parser.add_argument(f"--{name}", required=True, help=f"{what}: a Parquet table, or what --packed says")
    parser.add_argument("--packed", action="store_true", help="registries are a database of titles and files of hashed records")
    parser.add_argument("--form", default="json", choices=("json", "parquet", "text"))
    parser.add_argument("--batch", help="name of this batch: run again, it replaces its own results")
    given = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quirelight").getOrCreate()
    form = packed if given.packed else registries
    tables = (form.read_titles(spark, given.titles), form.read_journals(spark, given.journals), form.read_words(spark, given.words))
    found = recognize(requests.read_contents(spark, given.payloads), *tables)
    counts = requests.write_results(found, given.out, given.form, given.batch)
    print(json.dumps(counts))


if __name__ == "__main__":
    main()
