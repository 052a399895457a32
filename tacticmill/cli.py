"""Runs queries and pipeline steps from a shell: python -m tacticmill.cli --help."""

from __future__ import annotations

import argparse
import json
import sys

from tacticmill.session import clear_written, local_session
from tacticmill.sources.io import RunState, check_environment, load_config, run_pipeline

#: Steps of the usual jobs, in order.
JOBS = {
    "clean": ["valid_proofs", "without_placeholders", "bad_records", "dedup_by_hash", "clean_theorems"],
    "chains": ["chain_build", "chain_compress", "chain_flatten", "contiguity_check", "chain_audit"],
    "corpus": ["corpus_gate", "encode_text", "metadata_export", "vector_norms"],
    "contrastive": ["cited_premises", "resolved_premises", "positive_pairs", "contrastive_samples"],
    "reflection": ["errors_to_steps", "reflection_quality", "reflection_consistency", "output_enrichment", "ratio_split_keys"],
    "augment": ["error_hints", "argument_errors", "synthetic_statements", "ratio_mix"],
}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tacticmill", description="Queries over a folder of Parquet tables.")
    parser.add_argument("--config", help="JSON or YAML file with values for input, output, step, job, state and cores; options given here win")
    parser.add_argument("--input", help="folder with the tables")
    parser.add_argument("--output", help="folder for the results; without it they are shown")
    parser.add_argument("--step", action="append", default=[], help="a query's name; may be repeated; in order")
    parser.add_argument("--job", action="append", default=[], choices=sorted(JOBS), help="a named list of steps; may be repeated")
    parser.add_argument("--check", action="store_true", help="check paths and libraries and stop; exit code 1 if one is missing")
    parser.add_argument("--resume-from", help="first step to run")
    parser.add_argument("--state", help="file with the run state")
    parser.add_argument("--status", action="store_true", help="print the run state")
    parser.add_argument("--dry-run", action="store_true", help="name the steps that would run")
    parser.add_argument("--list", action="store_true", help="name all queries")
    parser.add_argument("--cores")
    options = parser.parse_args(args)
    for key, value in (load_config(options.config) if options.config else {}).items():
        if key not in ("input", "output", "step", "job", "state", "cores"):
            parser.error(f"unknown setting: {key}")
        if not getattr(options, key):
            setattr(options, key, value)
    if not options.input:
        parser.error("--input is required, here or in the configuration")
    options.step = [s for job in options.job for s in JOBS[job]] + list(options.step)
    if options.check:
        found = check_environment({"input": options.input, **({"config": options.config} if options.config else {})}, ["pyspark", "pyarrow", "pandas", "numpy"])
        print("\n".join(f"{'ok' if ok else 'missing'}\t{what}\t{name}" for name, what, ok in found))
        return 0 if all(ok for *_, ok in found) else 1
    try:
        with open(options.state or "") as f:
            state = RunState.from_json(f.read())
    except (OSError, TypeError, ValueError):
        state = RunState()
    if options.status:
        print(json.dumps(state.steps, indent=2, sort_keys=True))
        return 0
    from tacticmill.plans import registry

    queries = registry.queries()
    if options.list:
        print("\n".join(sorted(queries)))
        return 0
    unknown = [s for s in options.step if s not in queries]
    if unknown:
        parser.error(f"no such query: {', '.join(unknown)}")
    if options.dry_run:
        print("\n".join(run_pipeline(state, dict.fromkeys(options.step, lambda: ""), options.resume_from, dry_run=True)))
        return 0
    spark = local_session(options.cores or "*")

    def step(name: str):
        def run() -> str:
            df = queries[name](spark, options.input)
            if not options.output:
                df.show(truncate=False)
                return ""
            path = f"{options.output.rstrip('/')}/{name}"
            df.write.mode("overwrite").parquet(path)
            return path

        return run

    try:
        run_pipeline(state, {s: step(s) for s in options.step}, options.resume_from)
        clear_written(spark)
    finally:
        if options.state:
            with open(options.state, "w") as f:
                f.write(state.to_json())
    return 0


if __name__ == "__main__":
    sys.exit(main())
