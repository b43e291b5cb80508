"""Near copies: texts whose sets of five-word shingles are alike, by MinHash.

A sketch keeps 16 bits of the least value of each of 128 hash functions.  Texts that agree in
one of 25 bands of five values meet; each is compared, by the share of equal values, with one
member of the meeting point, not with all.  Which member that is changes from band to band, so
that a text is compared with several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitestance.llm import minhash
from sitestance.llm.common import look_up, stored

THRESHOLD = 0.8
WIDTH = 5
BANDS = minhash.FUNCTIONS // WIDTH
_ORDERS = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 4, dtype=np.int64).tolist()


def sketch(data: bytes) -> bytes:
    """Two bytes for each hash function over the shingles of a text; case does not count."""
    least = minhash.signature(minhash.shingle_hashes(data.lower().split()))
    return least.astype("<u2").tobytes()


def near_links(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links ``(a, b)`` between ``node``s whose sketches agree in at least such a share of values.

    ``texts`` has one row ``(node, scope, sketch)`` for each text and is stored; only texts of one
    scope meet.  Links number at most BANDS for each text, however many texts meet.
    """
    keys = [
        F.xxhash64("scope", F.substring("sketch", 2 * WIDTH * i + 1, 2 * WIDTH), F.lit(i)) for i in range(BANDS)
    ]
    rows = texts.select("node", F.posexplode(F.array(*keys)).alias("band", "key"))
    order = F.element_at(F.array(*map(F.lit, _ORDERS)), F.col("band") % len(_ORDERS) + 1)
    rows = rows.select("node", "key", order.alias("order"))
    drawn = F.col("node").bitwiseXOR(F.col("order"))
    heads = rows.groupBy("key", "order").agg(F.min(drawn).alias("least"), F.max(drawn).alias("most"))
    heads = heads.where("least < most").select("key", F.col("least").bitwiseXOR(F.col("order")).alias("head"))
    met = look_up(rows.drop("order"), stored(heads, "alike-heads"), ["key"], spread=["node"], how="inner")
    pairs = stored(met.where("node <> head").select("node", "head").distinct(), "alike-pairs")
    sketches = texts.select("node", F.col("sketch").alias("of_head"))
    used = pairs.select("head").distinct()
    used = stored(used.join(sketches, F.col("head") == F.col("node")).select("head", "of_head"), "alike-sketches")
    both = look_up(pairs.join(texts.select("node", "sketch"), "node"), used, ["head"], ["node"], "inner", weight=F.lit(16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, minhash.FUNCTIONS)
                for c in (2, 3)
            )
            alike = pa.array((a == b).mean(axis=1) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(alike) for c in (0, 1)], ["a", "b"])

    return both.select("node", "head", "sketch", "of_head").mapInArrow(run, "a bigint, b bigint")
