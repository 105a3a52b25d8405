"""What operators bring to the driver stays small."""

import numpy as np

from fathom.llm import jaccard


def test_sketch_comes_to_the_driver_compressed(spark):
    """Half a byte for each of CELLS cells would be 16 MB, several times over in the driver's JVM; unpacked, the classes are right."""
    line = "one very common line that is in all of them "
    rows = [(i, line + f"and words {i} of its {i * 7} own {i * 11}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    noise = 3.0
    parts = jaccard.sketch_of(jaccard.fingerprints(docs, jaccard.SIZE), noise)
    assert len(parts) == jaccard.CHUNKS and sum(map(len, parts)) < jaccard.CELLS // 2 // 50
    count = np.bincount(jaccard._cells(np.concatenate(jaccard.shingle_sets([t for _, t in rows]))), minlength=jaccard.CELLS)
    classes = np.clip(np.floor(np.log2(np.maximum(count, 1) / noise)) + 1, 0, 15).astype(np.uint8)
    got = jaccard.unpacked_sketch(parts)
    assert classes.any() and (got & 15 == classes[::2]).all() and (got >> 4 == classes[1::2]).all()
