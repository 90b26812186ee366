"""``python -m plyweave.cli align|analyze|render|systems``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import analyze as Z
from .sources import features as FX
from .sources import files as S
from .sources import matrix as M


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="plyweave", description="Align variants of source files and trace features in them.")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, text in (("align", "write aligned rows and bit matrices"), ("analyze", "write the trace of each feature"), ("render", "write a page of one family"), ("systems", "list the systems")):
        p = verbs.add_parser(verb, help=text)
        p.add_argument("language", choices=sorted(S.SUFFIXES))
        p.add_argument("root", help="folder with a sub-folder for each variant" + ("" if verb in ("align", "systems") else ", or with --matrix an alignment: a matrix file or a folder of them"))
        p.add_argument("--output", default="output")
        p.add_argument("--atomic-types-file")
        p.add_argument("--strategy", default="progressive", choices=["progressive", "guide_tree"])
        p.add_argument("--matrix", action="store_true", help="read an alignment instead of aligning")
        p.add_argument("--features", help="Parquet table (systems_key, expr)")
        p.add_argument("--program", help="program that tells a set's expression, called as PROGRAM expr SPEC 'IDS '")
        p.add_argument("--spec", default="", help="what the program gets as SPEC")
        p.add_argument("--cores", type=int, help="threads of a local run; a cluster has its own settings")
        p.add_argument("--family", help="the family to render")
    a = parser.parse_args(args)
    builder = SparkSession.builder.appName("plyweave")
    spark = (builder.master(f"local[{a.cores}]") if a.cores else builder).getOrCreate()
    atomic = S.atomic_tags(spark, a.atomic_types_file) if a.atomic_types_file else None
    if a.verb == "systems":
        S.discover(spark, a.root, a.language).select("variant").distinct().orderBy(*S.variant_order()).show(1000, False)
        return
    if a.verb == "align" or not a.matrix:
        t = Z.align_sources(spark, a.root, a.language, atomic, a.strategy)
    else:
        t = Z.read_alignment(spark, a.root, a.language, atomic)
    if a.verb == "align":
        M.write_named(M.human_texts(t["cells"], t["variants"]), a.output, ".txt")
        M.write_named(M.machine_texts(t["cells"], t["variants"]), a.output, ".output")
        t["cells"].write.mode("overwrite").parquet(f"{a.output}/cells")
        return
    if a.program:
        features = FX.from_program(Z.system_keys(t["cells"]), a.program, a.spec)
    elif a.features:
        features = spark.read.parquet(a.features)
    else:
        parser.error(f"{a.verb} needs --features or --program")
    if a.verb == "analyze":
        M.write_named(Z.trace_texts(Z.analyze(t["nodes"], t["cells"], features)), f"{a.output}/traces", ".txt", "feature")
        return
    family = a.family or t["cells"].agg(F.min("family")).first()[0]
    page = spark.createDataFrame([("page", Z.view(t["nodes"], t["cells"], features, family))], "family string, content string")
    M.write_named(page, a.output, ".html")


if __name__ == "__main__":
    main()
