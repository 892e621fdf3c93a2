"""Command line: python -m veltra.cli --config run.yaml [--output folder] [--seed 1] [--input-type vcf|expression] [--master url]."""

from __future__ import annotations

import argparse
import dataclasses
import sys


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veltra")
    p.add_argument("-c", "--config", required=True)
    p.add_argument("-o", "--output")
    p.add_argument("-s", "--seed", type=int)
    p.add_argument("-t", "--input-type", choices=["vcf", "expression"])
    p.add_argument("--expression-method", choices=["ssgsea", "gsva", "mean_z"])
    p.add_argument("--verbose", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--master", help="Spark master; by default the environment's, or local cores where it sets none")
    a = p.parse_args(arguments)
    from .config import ConfigError, load_yaml, validate

    try:
        loaded = load_yaml(a.config)
        if a.input_type:
            loaded.setdefault("data", {})["input_type"] = a.input_type
        config = validate(loaded)
    except (ConfigError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    over = {"output_dir": a.output, "seed": a.seed, "expression_scoring_method": a.expression_method, "verbose": False if a.quiet else a.verbose}
    config = dataclasses.replace(config, **{k: v for k, v in over.items() if v is not None})
    from .pipeline import markdown, run
    from .session import session

    result = run(session(a.master), config)
    if config.verbose:
        print(markdown(result.report))
    return 0


if __name__ == "__main__":
    sys.exit(main())
