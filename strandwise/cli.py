"""Command line: ``python -m strandwise.cli asm|gfa|map``."""

from __future__ import annotations

import argparse
import json

from .plans import assembly
from .plans.assembly import Assembly, Parameters
from .session import build_session, materialize
from .sources import fastx, gfa


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandwise", description="Assemble long reads on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("asm", help="assemble reads into contigs")
    c.add_argument("--out-dir", required=True)
    source = c.add_mutually_exclusive_group(required=True)
    source.add_argument("--in-hifi", nargs="+")
    source.add_argument("--in-ont", nargs="+")
    c.add_argument("--threads", default="*")
    c.add_argument("--kmer-size", type=int, default=15)
    c.add_argument("--density-assembly", type=float, default=0.005)
    c.add_argument("--density-correction", type=float, default=0.025)
    c.add_argument("--max-k", type=int, default=0)
    c.add_argument("--min-abundance", type=int, default=0)
    c.add_argument("--max-bubble-length", type=int, default=50_000)
    c.add_argument("--max-tip-length", type=int, default=50_000)
    c.add_argument("--min-read-identity", type=float, default=0.96)
    c.add_argument("--min-read-overlap", type=int, default=1000)
    c.add_argument("--min-read-quality", type=float, default=0.0)
    c.add_argument("--min-contig-length", type=int, default=50)
    c.add_argument("--min-contig-coverage", type=float, default=1.0)
    c.add_argument("--skip-correction", action="store_true")
    c.add_argument("--all-assembly-graph", action="store_true", help="write the last graph as GFA too")
    c = commands.add_parser("gfa", help="write the graph of an assembly")
    c.add_argument("--assembly-dir", required=True)
    c.add_argument("--bare", action="store_true", help="without sequences")
    c.add_argument("--threads", default="*")
    c = commands.add_parser("map", help="map sequences onto the graph of an assembly")
    c.add_argument("--assembly-dir", required=True)
    c.add_argument("--contigs", nargs="+", required=True)
    c.add_argument("--threads", default="*")
    return top


def _parameters(a: argparse.Namespace) -> Parameters:
    return Parameters(
        platform="hifi" if a.in_hifi else "ont", kmer_size=a.kmer_size, density=a.density_assembly, density_correction=a.density_correction, max_k=a.max_k,
        min_abundance=a.min_abundance, max_bubble=a.max_bubble_length, max_tip=a.max_tip_length, min_read_quality=a.min_read_quality,
        min_contig_length=a.min_contig_length, min_contig_coverage=a.min_contig_coverage, min_overlap=a.min_read_overlap, min_identity=a.min_read_identity,
        correction=False if a.skip_correction else None,
    )


def main(arguments: list[str] | None = None) -> int:
    a = _parser().parse_args(arguments)
    if a.command == "asm":
        p = _parameters(a)
        print(json.dumps(assembly.run_assembly(build_session(a.threads), a.in_hifi or a.in_ont, a.out_dir, p, with_graph=a.all_assembly_graph)))
        return 0
    spark = build_session(a.threads)
    saved = Assembly(spark, a.assembly_dir)
    p, passes = saved.parameters(), saved.passes()
    if a.command == "gfa":
        assembly.write_graph(saved, f"{saved.out}/graph_k{passes.k}.gfa", a.bare)
        assembly.contig_paths(saved).write.csv(f"{saved.out}/contig_paths.csv", header=True, mode="overwrite")
        return 0
    places = materialize(assembly.graph_places(fastx.scan(spark, a.contigs), passes.unitigs, passes.k, p))
    path = materialize(assembly.map_to_graph(places))
    path.write.csv(f"{saved.out}/paths.csv", header=True, mode="overwrite")
    assembly.colours(places).write.csv(f"{saved.out}/position_colors.csv", header=True, mode="overwrite")
    near = materialize(assembly.mapped_subgraph(path, passes.unitigs, passes.k, p))
    gfa.write_gfa(*assembly.graph_tables(near, passes.k, p), f"{saved.out}/mapped.gfa")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
