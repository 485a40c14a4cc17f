"""python -m kinlink link BASE OUT: training and results. python -m kinlink recall BASE: blocking recall of the training split."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kinlink.operators import metrics
from kinlink.plans import linkage
from kinlink.sources.tables import TRUTH, read_tsv, truth_pairs


def run() -> None:
    parser = argparse.ArgumentParser(prog="kinlink", description=__doc__)
    parser.add_argument("command", choices=("link", "recall"))
    parser.add_argument("base", help="folder of {train,test}_source{1,2,3}.tsv and train_ground_truth.tsv")
    parser.add_argument("out", nargs="?", help="folder of results")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("kinlink").getOrCreate()
    if args.command == "link":
        if not args.out:
            parser.error("link needs OUT")
        linkage.main(spark, args.base, args.out)
    else:
        rec = linkage.records({s: read_tsv(spark, f"{args.base}/train_source{s}.tsv") for s in (1, 2, 3)})
        gt = truth_pairs(read_tsv(spark, f"{args.base}/train_ground_truth.tsv", TRUTH), rec)
        metrics.recall_at_k(linkage.block(rec), gt).orderBy("k").show()


if __name__ == "__main__":
    run()
