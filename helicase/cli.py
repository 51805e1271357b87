"""python -m helicase fad|rad --input reads.fasta --output templates.fasta"""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace

from pyspark.sql import SparkSession

from .params import AlignParams, ClusterMode, ConsensusParams, FadParams, RadParams
from .plans.fad import fad_denoise
from .plans.rad import rad_denoise
from .sources import fasta


def _options(parser: argparse.ArgumentParser, values: dict[str, object]) -> None:
    for name, default in values.items():
        flag = "--" + name.replace("_", "-")
        if isinstance(default, bool):
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=default)
        else:
            parser.add_argument(flag, type=type(default), default=default)


_FAD = {f: getattr(FadParams(), f) for f in ("k", "neighbor_threshold", "min_count", "sketch_size", "use_sketch", "sketch_prefilter_threshold", "verbose")}
_RAD_OWN = (
    "k", "rough_radius", "min_cluster_size", "fine_split", "fine_split_max_depth", "fine_split_top_kmers", "fine_split_min_var", "fine_split_radius",
    "fine_split_min_features", "use_sketch", "sketch_size", "sketch_prefilter_threshold", "sketch_top_k", "sketch_fallback_exact", "sketch_radius",
    "sketch_max_iter", "sketch_max_bins", "rough_max_iter", "fine_split_max_iter", "verbose",
)
_RAD = {f: getattr(RadParams(), f) for f in _RAD_OWN} | {f: getattr(ConsensusParams(), f) for f in ("polish_rounds", "max_consensus_reads", "max_centroid_candidates", "max_centroid_comparisons")} | {"fad_clean": True, "align_band": 64}


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="helicase", description="Template sequences from noisy amplicon reads.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in (("fad", _FAD), ("rad", _RAD)):
        sub = commands.add_parser(name)
        sub.add_argument("-i", "--input", required=True)
        sub.add_argument("-o", "--output", required=True)
        _options(sub, options)
        if name == "rad":
            sub.add_argument("--cluster-mode", default=ClusterMode.SKETCH_PRECLUSTER.value)
    return parser


def rad_params(args: argparse.Namespace) -> RadParams:
    own = {f: getattr(args, f) for f in _RAD_OWN}
    consensus = ConsensusParams(args.k, polish_rounds=args.polish_rounds, max_consensus_reads=args.max_consensus_reads, max_centroid_candidates=args.max_centroid_candidates, max_centroid_comparisons=args.max_centroid_comparisons, align=AlignParams(band=args.align_band))
    return replace(RadParams(**own), cluster_mode=ClusterMode.of(args.cluster_mode), run_fad_clean=args.fad_clean, consensus=consensus)


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if getattr(args, "verbose", False):
        logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName(f"helicase {args.command}").getOrCreate()
    reads = fasta.read_reads(spark, args.input)
    if args.command == "fad":
        records = fasta.fad_records(fad_denoise(reads, FadParams(**{f: getattr(args, f) for f in _FAD})).templates)
    else:
        records = fasta.rad_records(rad_denoise(reads, rad_params(args)).templates)
    fasta.write_fasta_file(records, args.output)
    return 0
