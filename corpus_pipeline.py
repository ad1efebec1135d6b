"""From raw documents to packed sequences: five stages, each a Parquet table for the next.

Every stage works on all rows that the one before it kept, takes and returns the columns of ``documents``
(the last returns packed pieces), and keeps rows whose doc_id is null until the last, which needs ids.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import nbsvm, packing, simhash, suffixes, toxicity
from llm.common import filtered, held_out, store, table

#: Names of columns that stages add and drop again; no table should have them.
ROW, SIZE, CUT = "__row_of_text", "__bytes_of_text", "__text_after_cut"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality 0.3 or more stay; the classifier is fitted on a bounded sample of labels."""
    raw, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    shared = spark.sparkContext.broadcast(nbsvm.fit(raw, labels, "quality", held_out(5) != 0))
    return filtered(docs, lambda texts: [shared.value.score(t) >= 0.3 for t in texts])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of toxicity 0.7 or more go."""
    raw, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    shared = spark.sparkContext.broadcast(toxicity.fit(raw, labels, "toxic", held_out(3) != 1))

    held: dict[str, toxicity.Counter] = {}  # per task: its table of words serves all batches

    def keep(texts: list[str]) -> list[bool]:
        count = held.get("counter") or held.setdefault("counter", toxicity.Counter(shared.value.lexicon))
        return [shared.value.score(count.features(t)) < 0.7 for t in texts]

    return filtered(docs, keep)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingle sets with a Jaccard of 0.8 or more) the least doc_id stays, once.

    Where that doc_id comes with several texts of the group, the one of the least hash stays. Rows without an id stay.
    """
    found = simhash.alike(docs, shingle=5).where("doc_id = component_id")
    first = found.groupBy("doc_id", "group").agg(F.min("row").alias(ROW)).select("doc_id", ROW).distinct()
    marked = docs.withColumn(ROW, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = marked.join(first, ["doc_id", ROW], "left_semi").dropDuplicates(["doc_id", ROW])
    return kept.unionByName(marked.where("doc_id IS NULL")).select(docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out; what is left of characters cut in two
    goes too, all other characters stay as they are. Texts of one doc_id are told apart by their bytes' number."""
    cut = suffixes.deduplicated(docs, length=50).where("n_removed > 0").dropDuplicates(["doc_id", "n_bytes"]).select("doc_id", "n_bytes", "kept")

    def mended(batches):
        for batch in batches:
            texts = pa.array([v.decode("utf-8", "ignore") for v in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["doc_id", SIZE, CUT])

    # The plan knows packs only by their few small rows, so it would take these texts for small and send
    # them to every task; they grow with the input.
    texts = cut.mapInArrow(mended, f"doc_id long, {SIZE} long, {CUT} string").hint("merge")
    rest = docs.withColumn(SIZE, F.octet_length("text").cast("long")).join(texts, ["doc_id", SIZE], "left")
    return rest.withColumn("text", F.coalesce(CUT, "text")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 1024 tokens."""
    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("toxicity", toxic), ("near copies", near_copies),
          ("suffix passages", passages), ("packing", packed)]
#: Classifiers, fingerprints and tokens are not expressible in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
