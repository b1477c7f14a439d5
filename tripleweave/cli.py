"""python -m tripleweave -c config.ini: make the graphs of a configuration's datasets."""

from __future__ import annotations

import argparse
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .config import RunConfig, load_config
from .operators.terms import Options
from .plans.engine import Engine
from .plans.loader import load
from .sinks.rdf import write, write_targets

SUFFIX = {"n-triples": ".nt", "n-quads": ".nq", "turtle": ".ttl", "rdf-json": ".rj"}


def run(spark: SparkSession, config: RunConfig) -> list[str]:
    """The paths of what was written: a folder a dataset, or one file where all datasets go into one."""
    options = Options(remove_duplicates=config.remove_duplicates)
    graphs, prefixes, out = [], {}, []
    for d in config.datasets:
        mapping = load(d.mapping)
        if d.connection:
            mapping = replace(mapping, maps={k: replace(m, source=replace(m.source, connection=d.connection)) if m.source.formulation == "SQL" and not m.source.connection else m for k, m in mapping.maps.items()})
        engine = Engine(spark, mapping, options)
        prefixes |= mapping.prefixes
        if mapping.targets:
            out += sorted(set(write_targets(engine, f"{config.output_folder}/{d.name}").values()))
        elif config.all_in_one_file:
            graphs.append(engine.graph())
        else:
            path = f"{config.output_folder}/{d.name}"
            write(engine.graph(), path, config.output_format, mapping.prefixes)
            out.append(path)
    if graphs:
        whole = reduce(DataFrame.unionByName, graphs)
        path = f"{config.output_folder}/{config.name}{SUFFIX.get(config.output_format, '')}"
        write(whole.dropDuplicates() if config.remove_duplicates else whole, path, config.output_format, prefixes, single_file=True)
        out.append(path)
    return out


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tripleweave", description=__doc__)
    parser.add_argument("-c", "--config", required=True)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tripleweave").getOrCreate()
    for path in run(spark, load_config(given.config)):
        print(path)
    return 0
