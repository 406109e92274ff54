"""Searches a source tree: ``python examples/search_tree.py FOLDER QUERY [MODEL.safetensors TOKENIZER.json]``."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from sonde.plans.index import formatted  # noqa: E402
from sonde.plans.session import SearchSession  # noqa: E402


def main(folder: str, query: str, *model: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    session = SearchSession(spark, *model)
    session.prewarm(folder)
    formatted(session.search(query, folder, top_k=5)).show(truncate=False)
    best = session.search(query, folder, top_k=1).first()
    if best:
        formatted(session.find_related(best["file_path"], best["start_line"], folder, top_k=5)).show(truncate=False)


if __name__ == "__main__":
    if len(sys.argv) not in (3, 5):
        sys.exit(__doc__)
    main(*sys.argv[1:])
