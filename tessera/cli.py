"""Command line: tokenize, finalize, inspect. The options of tokenize are the arguments of tokenize_catalog()."""

from __future__ import annotations

import argparse
import inspect
import logging
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tessera.plans import specs as plan
from tessera.plans.job import FETCH_MODES, share, tokenize_catalog
from tessera.sources.catalog import open_catalog
from tessera.sources.sink import VERSION, finalize

CHOICES = {"fetch_mode": FETCH_MODES, "token_dtype": ("int64", "int32")}
#: Options of launchers that Spark makes superfluous, and whether they have a value.
UNUSED = {"device": True, "cache-dir": True, "num-prefetch": True, "no-progress": False}


def options() -> dict[str, inspect.Parameter]:
    return {k: v for k, v in inspect.signature(tokenize_catalog).parameters.items() if v.kind is v.KEYWORD_ONLY and k != "codec"}


def _option(parser: argparse.ArgumentParser, name: str, kind: str, default: object) -> None:
    """The option of an argument by its annotation: a list is repeatable, a truth that may be None has a negative."""
    flag = "--" + name.replace("_", "-")
    if kind.startswith("Sequence"):
        parser.add_argument(flag.removesuffix("s"), dest=name, action="append")
    elif kind.startswith("bool"):
        parser.add_argument(flag, action="store_true" if default is False else argparse.BooleanOptionalAction, default=default)
    else:
        parser.add_argument(flag, type=int if kind.startswith("int") else str, default=default, choices=CHOICES.get(name))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Catalogs of images, spectra and scalars to catalogs of tokens")
    top.add_argument("--version", action="version", version=f"tessera {VERSION}")
    top.add_argument("-v", "--verbose", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    made = commands.add_parser("tokenize", help="tokenize a catalog, or this run's share of it")
    made.add_argument("source")
    made.add_argument("output")
    made.add_argument("-m", "--modality", action="append", dest="modalities", help="column, modality or column=modality; repeatable")
    made.add_argument("--num-procs", type=int, help="tasks at a time of a local Spark")
    for name, parameter in options().items():
        _option(made, name, parameter.annotation, parameter.default)
    for name, valued in UNUSED.items():
        made.add_argument(f"--{name}", action="store" if valued else "store_true", help="accepted without effect: Spark places, stages and fetches by itself")
    commands.add_parser("finalize", help="complete a catalog from the partitions there are").add_argument("output")
    commands.add_parser("inspect", help="properties, schema and what can be tokenized").add_argument("source")
    return top


def described(spark: SparkSession, source: str) -> str:
    """What `inspect` prints."""
    c = open_catalog(spark, source)
    lines = [c.url, f"{len(c.partitions)} partitions of orders {sorted({p.order for p in c.partitions})}"]
    lines += [f"{k}={v}" for k, v in c.properties.items()]
    lines += [f"{f.name}: {f.dataType.simpleString()[:100]}" for f in c.schema.fields]
    return "\n".join([*lines, *map(str, plan.detect(c.schema, c.name, c.band_labels))])


def main(argv: Sequence[str] | None = None) -> int:
    """Exit code: 1 if a partition failed."""
    given = parser().parse_args(argv)
    tokenizing = given.command == "tokenize"
    rank = share(given.rank, given.world_size)[0] if tokenizing else 0
    logging.basicConfig(level=logging.DEBUG if given.verbose else logging.INFO, format=f"%(asctime)s [{rank}] %(name)s: %(message)s")
    builder = SparkSession.builder.appName("tessera")
    if tokenizing and given.num_procs:
        builder = builder.master(f"local[{given.num_procs}]")
    spark = builder.getOrCreate()
    if not tokenizing:
        print(described(spark, given.source) if given.command == "inspect" else finalize(given.output, spark=spark))
        return 0
    report = tokenize_catalog(spark, given.source, given.output, given.modalities or "auto", **{k: getattr(given, k) for k in options()})
    print(report)
    return 0 if report.ok else 1


if __name__ == "__main__":
    raise SystemExit(main())
