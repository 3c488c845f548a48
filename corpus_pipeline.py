"""From raw documents to packed sequences: STAGES in their order, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import exact_dedup, jaccard_join, packing, quality, substring_dedup
from grainmill.llm.common import fold, release_since, stash, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents with a lower probability of good quality go.
QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches QUALITY; the classifier is fitted on labelled rows outside the held-out fold. Null text is scored as
    empty; repeated rows and rows without doc_id are judged each."""
    sample_of = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    sample = stash(quality.labelled_sample(sample_of, labels, "quality", fold("doc_id", 5) != 0, quality.TRAIN_ROWS), "quality-sample")
    scored = quality.quality_scores(docs.select(*COLUMNS), quality.train(sample), only_score=False)
    return scored.where(F.col("score") >= QUALITY).select(*COLUMNS)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts, null being empty, the row with the smallest doc_id stays; of rows that repeat both, one."""
    return exact_dedup.exact_dedup(docs.select(*COLUMNS), keep="smallest").where("kept").select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, 80 % in common) the document that names the component stays; rows without doc_id and texts
    without words stay."""
    found = stash(jaccard_join.near_components(docs, n=5, percent=80), "near")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller doc_id has; characters cut in two go, n_chars follows the text. Rows without
    doc_id and short texts are as before."""
    return substring_dedup.replace_text(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every piece of the packed sequences; an empty text is one end id."""
    return packing.best_fit_packing(docs, short_first=True)


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("suffix-array dedup", substring_stage),
    ("best-fit packing", packing_stage),
]
#: SQL expresses neither the classifier nor the packing; tests/llm hold run() against brute force, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Null and empty texts, ties and repeated rows are each stage's to define; extra columns of documents are
    not read, and an empty table gives no rows. What a stage wrote is deleted once the next one has stored its rows."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release_since(spark, mark, docs)
    return docs
