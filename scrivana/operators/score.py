"""Scoring of predictions against references, page by page."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.functions import text as T
from scrivana.operators.index import case_of
from scrivana.operators.tables import cell_error_rate, table_fields
from scrivana.sources import readers


@dataclass(frozen=True)
class ScoringPolicy:
    normalisation: T.NormalisationPolicy = field(default_factory=T.NormalisationPolicy)
    degenerate_length_multiple: float = 3.0
    percentiles: tuple[int, ...] = (50, 90, 100)
    cell_comparison: str = "normalised"

    def __post_init__(self):
        bad = [p for p in self.percentiles if isinstance(p, bool) or not isinstance(p, int) or not 1 <= p <= 100]
        if bad or not self.degenerate_length_multiple > 1 or self.cell_comparison not in ("normalised", "strict"):
            raise ValueError(f"scoring policy: percentiles {bad or 'fine'}, multiple {self.degenerate_length_multiple}, cell comparison {self.cell_comparison!r}; expected whole percentiles 1..100, a multiple over 1, normalised or strict")


def with_predictions(pages: DataFrame, predictions: DataFrame, key: list[str], allow_missing: bool) -> DataFrame:
    """Pages with their predictions; a page without one is kept with a null, or fails."""
    joined = pages.join(predictions, key, "left")
    if allow_missing:
        return joined
    missing = F.assert_true(F.col("prediction").isNotNull(), F.lit("a page has no prediction"))
    return joined.withColumn("_checked", missing).where(F.col("_checked").isNull()).drop("_checked")


def score_pages(pages: DataFrame, key: list[str], policy: ScoringPolicy = ScoringPolicy(), tables: bool = True) -> DataFrame:
    """(reference, prediction) texts to distances, rates and table fields; all of them null where there is no prediction."""
    ref, pred = F.col("reference"), F.col("prediction")
    there = pred.isNotNull()
    rows = pages.withColumns({"_strict": T.text_distance(ref, pred), "_d": T.normal_distances(ref, pred, policy.normalisation)})
    strict, normalised = F.col("_strict"), F.coalesce("_d.normalised", "_strict")
    rows = rows.select(
        *pages.columns,
        F.length(ref).alias("ref_chars"),
        F.length(pred).alias("pred_chars"),
        there.alias("prediction_present"),
        strict.alias("strict_edit_distance"),
        F.when(there, T.error_rate(strict, F.length(ref), F.length(pred))).alias("strict_cer"),
        normalised.alias("normalised_edit_distance"),
        F.when(there, T.error_rate(normalised, F.col("_d.reference_chars"), F.col("_d.prediction_chars"))).alias("normalised_cer"),
        F.when(there, T.error_rate(F.col("_d.words"), F.col("_d.reference_words"), F.col("_d.prediction_words"))).alias("normalised_wer"),
        F.when(there, T.is_degenerate(ref, pred, policy.degenerate_length_multiple)).alias("degenerate"),
    )
    if not tables:
        return rows
    compared = table_fields(ref, pred, policy.normalisation if policy.cell_comparison == "normalised" else None)
    return rows.withColumn("_t", compared).select(*rows.columns, "_t.*").withColumn("table_cell_error_rate", cell_error_rate())


#: Corpora times models up to which these are broadcast to the pages.
FEW_PAIRS = 10_000

ROW = ("model", "corpus", "case_id", "doc_type", "family", "severity", "verified")


def pairing_faults(matrix: DataFrame, corpora: DataFrame, runs: DataFrame) -> DataFrame:
    """(corpus, model, fault): what forbids scoring.

    matrix: (corpus, manifest_sha256) as indexed. corpora: (corpus, manifest_sha256, prompt_sha256) as they stand.
    runs: (model, corpus, prompt_sha256, corpus_manifest_sha256), one for each folder of predictions there is.
    """
    found = corpora.select("corpus", F.col("manifest_sha256").alias("_now"), F.col("prompt_sha256").alias("_prompt"))
    indexed = matrix.select("corpus", "manifest_sha256").join(found, "corpus", "left")
    stale = indexed.where(~F.col("manifest_sha256").eqNullSafe(F.col("_now")))
    faults = stale.select("corpus", F.lit(None).cast("string").alias("model"), F.when(F.col("_now").isNull(), "no such corpus").otherwise("exported again since it was indexed").alias("fault"))
    used = runs.join(indexed.select("corpus", "_now", "_prompt"), "corpus")
    for column, now, fault in (("prompt_sha256", "_prompt", "another prompt"), ("corpus_manifest_sha256", "_now", "another vintage of the corpus")):
        faults = faults.unionByName(used.where(~F.col(column).eqNullSafe(F.col(now))).select("corpus", "model", F.lit(fault).alias("fault")))
    return faults


def score_corpora(matrix: DataFrame, corpora: DataFrame, pages: DataFrame, runs: DataFrame, predictions: DataFrame, policy: ScoringPolicy = ScoringPolicy(), allow_missing: bool = False, verified: bool = True) -> DataFrame:
    """Rows of every corpus of an index with every model that has predictions for it.

    pages: (corpus, stem, case_id, doc_type, reference). predictions: (model, corpus, stem, prediction). A stale index,
    a run on another prompt or vintage, an index without any run, and (unless allowed) a page without a prediction fail.
    """
    faults = pairing_faults(matrix, corpora, runs)
    if not faults.isEmpty():
        raise ValueError(f"can't score: {[tuple(r) for r in faults.limit(5).collect()]}")
    pairs = matrix.select("corpus", "family", "severity").join(runs.select("model", "corpus").distinct(), "corpus")
    n = pairs.count()
    if not n:
        raise ValueError("no corpus of the index has predictions of any model")
    # by corpus, texts would come to as many tasks as there are corpora
    wanted = pages.select("corpus", "stem", "case_id", "doc_type", "reference").join(F.broadcast(pairs) if n <= FEW_PAIRS else pairs, "corpus")
    both = with_predictions(wanted, predictions.select("model", "corpus", "stem", "prediction"), ["model", "corpus", "stem"], allow_missing)
    rows = score_pages(both.withColumn("verified", F.lit(verified)), ["model", "corpus", "stem"], policy)
    return rows.select(*ROW, *(c for c in rows.columns if c not in (*ROW, "stem", "reference", "prediction")))


def score_folders(spark: SparkSession, matrix: str, predictions: str, policy: ScoringPolicy = ScoringPolicy(), allow_missing: bool = False, verify: bool = True) -> DataFrame:
    """``score_corpora`` on files: a matrix beside its corpora (manifest.jsonl, prompt.md, transcripts, images), and
    predictions below ``<model>/<corpus>/`` (run.json and one text a page). With ``verify``, images must have the bytes
    that their manifest states."""
    base = matrix.rsplit("/", 1)[0]
    index = readers.json_lines(spark, matrix, readers.MATRIX)
    manifests = readers.manifests(spark, base)
    prompts = readers.prompt_hashes(spark, base)
    corpora = manifests.select("corpus", "manifest_sha256").distinct().join(prompts, "corpus", "left")
    if verify:
        bad = readers.image_faults(spark, base, manifests.join(index.select("corpus"), "corpus", "left_semi"))
        if not bad.isEmpty():
            raise ValueError(f"images differ from their manifest: {[tuple(r) for r in bad.limit(5).collect()]}")
    pages = manifests.select("corpus", "stem", case_of(F.col("stem"), F.col("doc_type")).alias("case_id"), "doc_type").join(readers.corpus_texts(spark, base).withColumnRenamed("text", "reference"), ["corpus", "stem"], "left")
    missing = pages.where(F.col("reference").isNull())
    if not missing.isEmpty():
        raise ValueError(f"pages without a transcript: {[r.stem for r in missing.limit(5).collect()]}")
    return score_corpora(index, corpora, pages, readers.runs(spark, predictions), readers.predicted_texts(spark, predictions), policy, allow_missing, verify)
