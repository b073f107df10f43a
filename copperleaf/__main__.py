"""python -m copperleaf parse|ddl|load|validate|status ..."""

from __future__ import annotations

import argparse

from copperleaf.plans import ddl
from copperleaf.plans.schema import Options, compile_copybook, to_json


def route_of(text: str | None) -> tuple[int, int, dict[str, str]] | None:
    if not text:
        return None
    offset, length, *types = text.split(",")
    return int(offset), int(length), dict(x.split("=", 1) for x in types)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="copperleaf")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("parse", "ddl", "load", "validate"):
        q = sub.add_parser(name)
        q.add_argument("copybook")
        q.add_argument("--filler", default="skip", choices=["skip", "warn", "keep"])
        q.add_argument("--redefines", default="wide", choices=["wide", "subtype", "json"])
        q.add_argument("--occurs", default="child", choices=["child", "json", "wide"])
        q.add_argument("--out")
        if name == "ddl":
            q.add_argument("--dialect", default="postgres", choices=["postgres", "sqlserver", "spark"])
            q.add_argument("--lookups", action="store_true")
        if name in ("load", "validate"):
            for x in ("data", "target", "state"):
                q.add_argument(f"--{x}", required=True)
            q.add_argument("--recfm", default="F", choices=["F", "FB", "V", "VB", "D"])
            q.add_argument("--record-length", type=int)
            q.add_argument("--skip", type=int, default=0)
            q.add_argument("--route", help="offset,length,value=table,... of the record type")
            q.add_argument("--unmatched", default="default", choices=["default", "skip"])
            q.add_argument("--mode", default="truncate_load", choices=["truncate_load", "append", "upsert"])
            q.add_argument("--on-error", default="reject", choices=["reject", "null"])
            q.add_argument("--page", default="cp037")
            q.add_argument("--ascii", action="store_true")
            q.add_argument("--free", action="store_true")
        if name == "validate":
            q.add_argument("run")
    q = sub.add_parser("status")
    q.add_argument("state")
    a = p.parse_args(argv)
    if a.command in ("parse", "ddl"):
        with open(a.copybook, encoding="utf-8") as f:
            schema = compile_copybook(f.read(), Options(filler=a.filler, redefines=a.redefines, occurs=a.occurs))
        text = to_json(schema) if a.command == "parse" else ddl.script(schema, a.dialect, lookups=a.lookups)
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
        return
    from pyspark.sql import SparkSession

    from copperleaf.operators.decode import DecodeOptions
    from copperleaf.plans.engine import RunConfig, Source, run, validate
    from copperleaf.plans.state import Store, run_summary

    spark = SparkSession.builder.appName("copperleaf").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command in ("load", "validate"):
        with open(a.copybook, encoding="utf-8") as f:
            text = f.read()
        source = Source(a.data, a.recfm, a.record_length, a.skip, route=route_of(a.route), unmatched=a.unmatched)
        config = RunConfig("cli", text, [source], a.target, a.state, a.mode, a.on_error, Options(filler=a.filler, redefines=a.redefines, occurs=a.occurs), a.free, DecodeOptions(page=a.page, ascii=a.ascii))
        if a.command == "load":
            print(run(spark, config))
        else:
            validate(spark, config, a.run).show(1000, truncate=False)
    else:
        run_summary(Store(spark, a.state).latest("table_migration_states")).show(truncate=False)


if __name__ == "__main__":
    main()
