"""From raw documents to packed training sequences.

Four stages, each a function of (spark, docs, sf_dir).  All but the last return
the columns of ``documents``:

1. quality: documents that the co-trained classifier rejects go.
2. near_duplicates: of the rows that the n-gram Jaccard join links, one stays: one
   with the least id (nulls last), and of these by a hash of all columns.  Rows
   that link with nothing stay, whatever other rows have their id.
3. repeats: bytes of strings of 200 bytes that occur anywhere else are removed
   from the texts; a document of which nothing is left goes.
4. packing: the documents are packed into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.llm.cotraining import quality_scores
from palimpsest.llm.jaccard import ngram_jaccard_join
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.repeats import suffix_array_dedup


#: Columns that stages read; a table may have any others, whatever their names.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """The known columns, and all others within one, so that no operator's own columns can clash with them."""
    others = [c for c in docs.columns if c not in KNOWN]
    more = [F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others))).alias("more")] if others else []
    return docs.select(*(c for c in KNOWN if c in docs.columns), *more)


def _together(rows: DataFrame, columns: list[str]) -> DataFrame:
    others = [c for c in columns if c not in KNOWN]
    return rows.select(*(F.col(c) if c in KNOWN else F.col("more")[f"c{others.index(c)}"].alias(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps.  Null and empty texts are scored like others; repeated rows fare alike; an empty table stays empty."""
    scored = quality_scores(_apart(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _together(scored.filter("keep"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows.  Null and empty texts link with nothing and stay; of repeated rows one stays."""
    own = _apart(docs)
    names = [F.xxhash64(F.lit(k), *own.columns).alias(f"_row{k}") for k in (0, 1)]
    keyed = own.select("*", *names)  # equal rows have equal names
    rows = keyed.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row0", "_row1").alias("row"), "text")
    found = ngram_jaccard_join(rows, id_col="row", size=5, threshold=(75, 100))
    # rows without words link with nothing and stay
    judged = found.filter("n_shingles > 0").groupBy("row").agg(F.count("*").alias("copies"), F.min(F.col("component_id") == F.col("row")).alias("stays"))
    judged = judged.filter("copies > 1 or not stays").select("row._row0", "row._row1", "stays")
    kept = keyed.join(judged, ["_row0", "_row1"], "left").filter("stays is null or stays")
    among = F.row_number().over(Window.partitionBy("_row0", "_row1").orderBy("_row0"))
    return _together(kept.withColumn("_among", among).filter("stays is null or _among = 1"), docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings.  Null and empty texts stay as they are, a null one as empty."""
    cut = suffix_array_dedup(_apart(docs), threshold=200, with_text=True, carry=True)
    cut = cut.filter("n_removed = 0 or kept <> ''").withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("kept").cast("long"))
    return _together(cut, docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences.  A null text counts as empty and is one token; repeated rows are packed again."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), max_tokens=2048, max_segments=2048)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]
#: SQL cannot express a fitted classifier or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
