"""Command line: python -m tessera normalize|block|infer|diagnose --s1 FILE --others FILE... --out DIR."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import learning
from tessera.operators import matching as m
from tessera.plans.stages import Stages
from tessera.sources import records

COMMANDS = ("normalize", "block", "infer", "diagnose")


def decisions(stages: Stages, model: str, threshold: float, unique: bool) -> DataFrame:
    """Accepted pairs of the compressed candidates, by the linear or the boosted model."""
    scored = stages.scored() if model == "linear" else learning.gbt_matcher(stages.features(), stages.truth())
    return m.decide(scored, threshold, unique=unique).select("country", "s1_id", "rec_id", "p")


def run(spark: SparkSession, command: str, s1: str, others: list[str], out: str, truth: str | None = None, model: str = "linear", threshold: float = 0.7, unique: bool = True) -> None:
    """Write the tables of one command below ``out``; ``truth`` adds reports."""
    stages = Stages(spark, "|".join([s1, *others, truth or ""]), records.tsv_records(spark, s1, others, truth))
    side, rec = stages.sides()
    if command == "normalize":
        records.write_norm(stages.records().drop("owner"), f"{out}/norm")
        return
    records.write_id_lists(side, stages.compressed(), f"{out}/candidate_pairs", "candidate_entity_ids")
    if truth:
        counts = m.entity_counts(stages.universe(), stages.truth(), stages.compressed())
        records.write_report(m.candidate_metrics(counts, rec.agg(F.count(F.lit(1)).alias("n_corpus"))), f"{out}/blocking_report")
    if command == "block":
        return
    found = decisions(stages, model, threshold, unique)
    records.write_id_lists(side, found, f"{out}/matching_results", "matched_entity_ids")
    if truth:
        counts = m.entity_counts(stages.universe(), stages.truth(), found)
        records.write_report(m.macro_metrics(counts), f"{out}/match_report")
        if command == "diagnose":
            records.write_report(m.loss_by_kind(counts), f"{out}/loss_report")
            records.write_report(m.optimise_threshold(stages.lists()), f"{out}/threshold_report")


def main() -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--s1", required=True, help="TSV of the clean register")
    parser.add_argument("--others", nargs="+", required=True, help="TSVs of the records to match")
    parser.add_argument("--truth", help="TSV of known matches")
    parser.add_argument("--out", required=True)
    parser.add_argument("--model", choices=("linear", "gbt"), default="linear")
    parser.add_argument("--threshold", type=float, default=0.7)
    parser.add_argument("--allow-shared", action="store_true", help="a record may be matched to several entities")
    a = parser.parse_args()
    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run(SparkSession.builder.getOrCreate(), a.command, a.s1, a.others, a.out, a.truth, a.model, a.threshold, not a.allow_shared)


if __name__ == "__main__":
    main()
