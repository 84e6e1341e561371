"""Build a search index from a references file: ``python -m txrisk.build_index --resources FOLDER``.

Reads ``references.json.gz`` in the folder, trains centroids, and writes the index as Parquet (``index``)
and, where it fits one machine, as a binary file (``ivf.bin``).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from txrisk.functions.features import quantized
from txrisk.operators import ivf
from txrisk.schema import DIMS
from txrisk.sources import resources
from txrisk.sources.resources import INTS

#: References up to which the binary file is written too.
ONE_MACHINE = 20_000_000


def build(spark: SparkSession, folder: str, nlist: int = ivf.MAX_CLUSTERS, iterations: int = 30) -> ivf.Index:
    refs = resources.references(spark, f"{folder}/references.json.gz")
    refs = refs.select("ref_id", *[quantized(F.col(f"v{d}")).alias(f"q{d}") for d in range(DIMS)], "is_fraud")
    refs = ivf.stash(refs)  # one pass over the gzipped array, and ids that stay
    n = refs.count()
    start = ivf.sampled_centroids(refs, INTS, max(1, -(-n // nlist)))
    index = ivf.build(refs, ivf.lloyd(refs, start, INTS, iterations), INTS)
    index.save(f"{folder}/index")
    if n <= ONE_MACHINE:
        resources.save_bytes(spark, resources.dump_index(resources.export_index(index)), f"{folder}/ivf.bin")
    return index


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--resources", default="./resources", help="folder of references.json.gz")
    p.add_argument("--nlist", type=int, default=ivf.MAX_CLUSTERS, help="clusters")
    p.add_argument("--iterations", type=int, default=30, help="k-means rounds")
    a = p.parse_args(args)
    index = build(SparkSession.builder.getOrCreate(), a.resources, a.nlist, a.iterations)
    print(f"{index.nlist} clusters written to {a.resources}")


if __name__ == "__main__":
    main()
