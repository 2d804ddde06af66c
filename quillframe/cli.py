"""python -m quillframe.cli COMMAND: jobs over a package or a folder of packages."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from quillframe import api
from quillframe.operators import translation
from quillframe.plans import documents


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillframe")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, writes: bool = True, **flags) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("path")
        if writes:
            c.add_argument("-o", "--output", required=True)
        for flag, options in flags.items():
            c.add_argument("--" + flag.replace("_", "-"), **options)
        return c

    switch = {"action": "store_true"}
    add("clean", False, output={}, also_normalize_tags=switch, dry_run=switch)
    add("notes-kind", kind={"choices": ["endnotes", "footnotes"], "default": "endnotes"})
    add("inject-footnotes", notes={"required": True}, overwrite=switch)
    add("transplant", blueprint={"required": True})
    add("strip-paragraph-bold")
    add("analyze", False)
    add("infer-headings", False, blueprint={}, output={}, insert_missing=switch)
    add("inspect", False)
    add("check", False)
    add("translate", False, output={}, source_lang={"default": "en"}, target_lang={"required": True}, model={}, concurrency={"type": int}, preserve_formatting=switch, dry_run=switch)
    sub.add_parser("list-models")
    return p


def _print(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in r))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(args)
    if a.command == "list-models":
        for p in translation.providers_from(dict(os.environ)):
            try:
                for i, capabilities in p.list_models():
                    print(p.name, i, capabilities, sep="\t")
            except translation.ProviderError as e:
                print(e, file=sys.stderr)
        return 0
    spark = spark or SparkSession.builder.appName("quillframe").getOrCreate()
    if a.command == "clean":
        if a.dry_run or not a.output:
            _print(documents.clean(api._parts(spark, a.path), a.also_normalize_tags).where("n_changed > 0").select("doc_id", "part_name", "n_changed"))
        else:
            print(api.strip_rsids(spark, a.path, a.output, a.also_normalize_tags))
    elif a.command == "notes-kind":
        api.convert_notes_kind(spark, a.path, a.output, a.kind)
    elif a.command == "inject-footnotes":
        with open(a.notes, encoding="utf-8") as f:
            _print(api.inject_footnotes(spark, a.path, a.output, json.load(f), a.overwrite))
    elif a.command == "transplant":
        api.transplant_body(spark, a.blueprint, a.path, a.output)
    elif a.command == "strip-paragraph-bold":
        print(api.strip_paragraph_bold(spark, a.path, a.output))
    elif a.command == "analyze":
        _print(api.analyze_blueprint(spark, a.path))
        _print(documents.sections(api._parts(spark, a.path)))
    elif a.command == "infer-headings":
        _print(api.infer_heading_levels(spark, a.path, a.blueprint, a.output, a.insert_missing).orderBy("doc_id", "p_idx"))
    elif a.command == "inspect":
        from quillframe.operators import packages

        _print(packages.inspect(api.read(spark, a.path).where("error is null").select("doc_id", "part_ord", "part_name", "data")).orderBy("doc_id", "part_ord"))
    elif a.command == "check":
        found = api.check_package(spark, a.path).persist()
        _print(found.orderBy("doc_id", "check_no", "seq"))
        return int(found.where("severity = 'issue'").limit(1).count() > 0)
    elif a.dry_run or not a.output:
        _print(documents.dump(api._parts(spark, a.path)).orderBy("doc_id", "p_idx").select("doc_id", "line"))
    else:
        chain = translation.providers_from(dict(os.environ), a.model)
        if not chain:
            print("no provider's key is set", file=sys.stderr)
            return 2
        _print(api.translate(spark, a.path, a.output, chain, a.source_lang, a.target_lang, a.concurrency, a.preserve_formatting))
    return 0


if __name__ == "__main__":
    sys.exit(main())
