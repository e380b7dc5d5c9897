"""A training corpus from raw documents: language, toxicity, near duplicates, mixture, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlog.llm import jaccard_join, language_id, mixing, piece_codec, toxicity
from sparrowlog.llm._common import discard, written
from sparrowlog.llm.queries import _rest, tokenizer_path

#: A text with n-grams enough to judge (language_id.FEW), of which less than this share is in any language's filter has no language that was learned.
LEAST_LANGUAGE = 0.2


def _by_place(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns named by their place, so that none has the name of one that a stage makes."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), [f"c{i}" for i in range(len(docs.columns))]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those without a letter and those in no learned language; a text too short to tell the latter stays.

    A null or empty text has no letter and goes.  Rows without an id are decided as
    others are; repeated rows all stay or all go.  If no row has text and language,
    nothing is learned and no document is in a learned language.  Any other columns,
    whatever their names, come through.
    """
    model = language_id.learn(docs.where(f"{_rest(3)} <> 1"))
    rows, names = _by_place(docs)
    out = language_id.predict(rows, model, text=f"c{docs.columns.index('text')}", keep=tuple(names), grams=True)
    return out.where(f"lang_pred <> 'und' and (n_grams < {language_id.FEW} or score >= {LEAST_LANGUAGE})").select(names).toDF(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by a score below 0.5.

    A null text counts as empty.  Rows without an id are scored but not learned
    from; repeated rows all stay or all go.  Without a label, or without documents
    that have one, no document is predicted toxic.  Any other columns come through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, allowed=f"{_rest(5)} <> 0")
    rows, names = _by_place(docs)
    out = toxicity.score(rows, model, text=f"c{docs.columns.index('text')}", keep=tuple(names))
    return out.where("predicted = 0").select(names).toDF(*docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id; documents without words stay.

    Five words a shingle, a similarity of 0.8 or more.  A row without an id goes by
    a hash of its columns, which comes after usual ids, so it is compared as others
    are, and leaves without an id.  Of repeated rows, by id and text, one stays; so of
    rows without words, too, if they are equal.  An empty table stays one.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(*docs.columns), 2) + F.lit(1 << 62))
    named = docs.select(F.struct(*docs.columns).alias("row"), own.alias("doc_id"), "text")
    found = jaccard_join.jaccard_components(named, k=5, percent=80)
    ids = found.where("doc_id = component_id").select("doc_id").distinct()
    return named.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources by weight: what each pass takes of a document, as a document.

    A text without words, or a null one, gives nothing and goes.  A null source is
    a source of its own, the last.  Repeated rows give each their share.  n_chars
    is that of the text taken.  Any other columns come through.
    """
    out = mixing.mixed_documents(docs, mixing.mix(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids): the pieces of each text of the mixture.

    A row for each row; a null or empty text has no pieces.
    """
    model = piece_codec.load_model(tokenizer_path())
    ids = piece_codec.encode(docs, model, keep=("doc_id", "lang", "source", "text"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", unique), ("mixing", mixture), ("pieces", pieces)]

#: Learned models and draws from permutations are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
