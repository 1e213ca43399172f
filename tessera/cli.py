"""Commands: python -m tessera.cli create_dataset | segment | validate."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    create = commands.add_parser("create_dataset", help="tiles with nodes, edges, labels and splits")
    run = commands.add_parser("segment", help="assign points to cells and write points, matrix and log")
    check = commands.add_parser("validate", help="summaries of segmented points")
    for p in (create, run):
        p.add_argument("--base_dir", required=True, help="folder with a platform's files")
        p.add_argument("--sample_type", required=True, help="platform profile")
        p.add_argument("--min_qv", type=float, default=None, help="least quality; the profile's where not given")
        p.add_argument("--k_bd", type=int, default=3)
        p.add_argument("--k_tx", type=int, default=3)
        p.add_argument("--dist_tx", type=float, default=5.0)
    create.add_argument("--data_dir", required=True)
    create.add_argument("--tile_width", type=float, required=True)
    create.add_argument("--tile_height", type=float, required=True)
    create.add_argument("--margin", type=float, default=10.0)
    create.add_argument("--neg_sampling_ratio", type=int, default=5)
    create.add_argument("--frac", type=float, default=1.0)
    create.add_argument("--val_prob", type=float, default=0.1)
    create.add_argument("--test_prob", type=float, default=0.2)
    run.add_argument("--save_dir", required=True)
    run.add_argument("--dist_bd", type=float, default=15.0)
    run.add_argument("--score_cut", type=float, default=0.5)
    run.add_argument("--reach", type=float, default=10.0, help="distance of score 0.5")
    run.add_argument("--use_cc", action=argparse.BooleanOptionalAction, default=True, help="fragments of what is left")
    check.add_argument("--segmented", required=True, help="transcripts folder of a segmentation")
    check.add_argument("--out", required=True)
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    from .operators import filters, matrix
    from .plans import dataset, segment
    from .sources import readers
    from .sources.profiles import PROFILES

    o = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    if o.command == "validate":
        points = spark.read.parquet(o.segmented)
        points = points.withColumn("cell_id", points["cell_id"]).replace({"UNASSIGNED": None}, subset=["cell_id"])
        matrix.tuning_metrics(points).write.parquet(f"{o.out}/tuning")
        matrix.gene_counts(points).write.parquet(f"{o.out}/genes")
        return
    profile = PROFILES[o.sample_type]
    points, vertices = readers.scan_points(spark, o.base_dir, profile), readers.scan_vertices(spark, o.base_dir, profile)
    least = profile.min_quality if o.min_qv is None else o.min_qv
    if o.command == "create_dataset":
        dataset.create_dataset(points, vertices, o.data_dir, o.tile_width, o.tile_height, profile.control_prefixes, least, margin=o.margin, k_tx=o.k_tx, dist_tx=o.dist_tx, k_bd=o.k_bd, ratio=o.neg_sampling_ratio, train=1 - o.val_prob - o.test_prob, val=o.val_prob, frac=o.frac)
    else:
        kept = filters.by_quality(points, profile.control_prefixes, least)
        segment.run_segmentation(kept, vertices, segment.by_distance(o.reach), o.save_dir, cut=o.score_cut, use_fragments=o.use_cc, k_tx=o.k_tx, dist_tx=o.dist_tx, k_bd=o.k_bd, dist_bd=o.dist_bd)


if __name__ == "__main__":
    main()
