"""A corpus pipeline in five stages, each over all that the one before kept. Very long texts are taken whole; columns of
documents other than text and n_chars stay as they are; an empty table gives an empty result."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpusq.llm import jaccard, mixing, pieces, quality, templates
from corpusq.llm.common import Tables, documents, written


#: By sf_dir and place in STAGES: the tables that stages have written for themselves, called one by one.
own_tables: dict[tuple[str, int], Tables] = {}


def stage(step):
    """A stage. It first removes what earlier stages have written for themselves for the same sf_dir: called one after the
    other, their results are tables by then. Nothing is removed that `docs` still reads, and calls of one stage leave
    each other's tables alone."""

    @wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        place = [f.__name__ for _, f in STAGES].index(step.__name__)
        for key in [k for k in own_tables if k[0] == sf_dir and k[1] < place]:
            own_tables[key].remove_unless_read_by(docs)
        return own_tables.setdefault((sf_dir, place), Tables()).kept(step, spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; lines above the limits go from the others. Rows with null or empty text fail."""
    return quality.cleaned(docs)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every row stays, null texts too."""
    return templates.drop_recurring(docs).select(*docs.columns)


@stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, by sets of five words that link from 0.8, stays."""
    return jaccard.representatives(docs, size=5, percent=80)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them; those without words are not taken."""
    return mixing.mixed(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces; null texts have none."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

#: SQL cannot express the classes of the join, the Pareto mix over them and the segmentation together; tests hold the
#: stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each writes for itself is removed once its result is a table."""
    docs = documents(spark, sf_dir)
    for k, (_, step) in enumerate(STAGES):
        own = Tables()
        docs = written(own.kept(step.__wrapped__, spark, docs, sf_dir), f"stage-{k}")
        own.remove_unless_read_by(docs)
    return docs
