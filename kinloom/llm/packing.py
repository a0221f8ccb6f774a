"""Filling fixed-capacity containers with items (problem 8).

Method: harmonic packing. An item of s tokens in a container of C belongs to the
class k = C div s (the reciprocal classes C/(k+1) < s <= C/k), and k items of the
class fill a container, whatever their exact sizes. Classes are packed by count
alone, independently in every worker part, so no running sum is needed. A text
longer than a container is cut into full containers and a rest, which is packed
as an item. The classes of large items leave most room, so each container of the
classes up to ``HOSTS`` takes one more item, of the class of the largest items
that always fit its room (the refinement of the method for its worst classes).

Sizes are tokens of a public tokenizer, whose file is a parameter. Worker parts
hold about ``PART_ROWS`` items by a hash of the item, so a class that holds most
items is spread like any other; a part leaves at most one unfilled container per
class.

Defined results: null and empty texts have no tokens and no container; repeated
rows are packed each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.plans.lineage import cut

CAPACITY = 2_048
PART_ROWS = 50_000
HOSTS = 3
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-splitting pattern that belongs to the public byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, item_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``item_id, n_tokens`` of every text with tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"], "n_tokens": [len(x) for x in enc.encode_ordinary_batch(pdf["text"].tolist(), num_threads=1)]})

    slim = docs.where(F.col(text) != "").select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return slim.mapInPandas(count, "item_id long, n_tokens int").where("n_tokens > 0")


def pieces(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Cut items at container borders: ``item_id, row_no, piece_no, start, size``; ``row_no`` tells repeated rows apart."""
    counts = counts.select("item_id", "n_tokens", F.monotonically_increasing_id().alias("row_no"))
    no = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece_no")
    p = counts.select("item_id", "row_no", "n_tokens", no).withColumn("start", F.col("piece_no") * capacity)
    return p.select("item_id", "row_no", "piece_no", "start", F.least(F.lit(capacity), F.col("n_tokens") - F.col("start")).alias("size"))


def packed(counts: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """``container, item_id, row_no, piece_no, start, size``: every piece in one container."""
    p = cut(pieces(counts, capacity))
    parts = max(1, -(-p.count() // part_rows))
    p = p.withColumn("part", F.pmod(F.xxhash64("row_no", "piece_no"), F.lit(parts)).cast("int"))
    p = p.withColumn("class", F.floor(F.lit(capacity) / F.col("size")).cast("int"))
    p = p.withColumn("no", F.row_number().over(Window.partitionBy("part", "class").orderBy(F.col("size").desc(), "row_no", "piece_no")))
    name = F.format_string("p%06d-c%d-%d", "part", "class", "nth")
    hosts = p.where(F.col("class") <= HOSTS).withColumn("nth", F.floor((F.col("no") - 1) / F.col("class"))).withColumn("container", name)
    room = capacity - F.sum("size")
    slots = hosts.groupBy("part", "container").agg(F.when(room > 0, F.greatest(F.ceil(F.lit(capacity) / room), F.lit(HOSTS + 1))).cast("int").alias("class")).dropna()
    slots = slots.withColumn("no", F.row_number().over(Window.partitionBy("part", "class").orderBy("container"))).withColumnRenamed("container", "guest_of")
    n_slots = slots.groupBy("part", "class").agg(F.count("*").alias("n_slots"))
    rest = p.where(F.col("class") > HOSTS).join(slots, ["part", "class", "no"], "left").join(n_slots, ["part", "class"], "left")
    rest = rest.withColumn("nth", F.floor((F.col("no") - 1 - F.coalesce("n_slots", F.lit(0))) / F.col("class")))
    rest = rest.withColumn("container", F.coalesce("guest_of", name))
    cols = ["container", "item_id", "row_no", "piece_no", "start", "size"]
    return hosts.select(cols).unionByName(rest.select(cols))


def containers(packing: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per container: number of pieces, tokens and unused tokens."""
    return packing.groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("size").alias("n_tokens")).withColumn("unused", capacity - F.col("n_tokens"))


def split_items(packing: DataFrame) -> DataFrame:
    """Items that lie in more than one container, so that were longer than one."""
    several = packing.groupBy("item_id", "row_no").agg(F.min("container").alias("a"), F.max("container").alias("b")).where("a <> b")
    return several.select("item_id").distinct()
