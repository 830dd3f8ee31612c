"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .common import read, stage_table
from .mixing import mix_sources
from .quality import quality_rules


def but_text(docs: DataFrame, *others: str) -> DataFrame:
    """docs as (others, text, __rest: all columns but the text in a struct), so that no column can clash with an operator's."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text"]
    return docs.select(*others, "text", F.struct(*rest).alias("__rest"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules and the base rule keep.

    Cases: null, empty and short texts fail the base rule and go; repeated rows are judged each by its text; a null
    doc_id is judged but not learned from; extra columns pass through, whatever their names."""
    out = quality_rules(but_text(docs, "doc_id"), read(spark, sf_dir, "labels"), keep=("__rest",), with_text=True)
    return out.where("kept").select(*[F.col("__text" if c == "text" else f"__rest.`{c}`").alias(c) for c in docs.columns])


ROW = "__row"
PLACE_BITS = 40  # of a row's number: its place in its file
PACKED_ROWS = 1 << 26  # rows whose numbers are broadcast, at most


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of its own for each row, whatever doc_id holds: by the file and the place in it where docs are
    Parquet files as read, which costs no disk; all else is written first."""
    keyed = _placed(docs)
    return stage_table(docs.withColumn(ROW, F.monotonically_increasing_id()), name) if keyed is None else keyed


def _placed(docs: DataFrame) -> DataFrame | None:
    """docs with ROW by file and place, or None if they are no Parquet files, or some of them twice. One row per file
    comes to the driver."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return None  # rows of other plans may share a place
    try:
        meta = docs.metadataColumn("_metadata")
        at = docs.select("*", meta["file_path"].alias("__path"), F.xxhash64(meta["file_path"]).alias("__file"), meta["row_index"].alias("__place"))
    except AnalysisException:
        return None
    files = sorted(at.groupBy("__file").agg(F.min("__path").alias("path"), F.count(F.lit(1)), F.max("__place")).collect(), key=lambda r: r["path"])
    if any(n != last + 1 for _, _, n, last in files):  # a file read twice, or two of one hash
        return None
    # a broadcast by strings takes a whole page of an executor's memory, one by numbers does not
    numbers = docs.sparkSession.createDataFrame([(f, i) for i, (f, _, _, _) in enumerate(files)], "__hash bigint, __number bigint")
    row = F.shiftleft("__number", PLACE_BITS) + F.col("__place")
    return at.join(F.broadcast(numbers), F.col("__file") == F.col("__hash")).select(*[F.col(f"`{c}`") for c in docs.columns], row.alias(ROW))


def chosen(keyed: DataFrame, times: DataFrame) -> DataFrame:
    """keyed with the number __n that times (__i, __n: 1 and more) has for a row; other rows go.

    Texts stay where they are: the numbers of 32 rows are broadcast as one word, 5 MB for 10 million rows. Past
    PACKED_ROWS, or with a number over 3, rows are joined."""
    times = stage_table(times.select("__i", F.col("__n").cast("bigint").alias("__n")), "row-times")
    rows, most = times.agg(F.count(F.lit(1)), F.max("__n")).first()
    if rows > PACKED_ROWS or (most or 0) > 3:
        return keyed.join(times, F.col(ROW) == F.col("__i")).drop("__i")
    words = times.groupBy(F.shiftright("__i", 5).alias("__word")).agg(F.bit_or(F.expr("shiftleft(__n, cast(2 * (__i & 31) as int))")).alias("__bits"))
    n = F.expr(f"shiftright(__bits, cast(2 * ({ROW} & 31) as int)) & 3")
    return keyed.join(F.broadcast(words), F.shiftright(ROW, 5) == F.col("__word")).withColumn("__n", n).where("__n > 0").drop("__word", "__bits")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the one with the smallest doc_id, nulls last, then the smallest text
    and other columns.

    Cases: rows are told apart whatever their doc_id, so one without an id or with another text's id is judged by its
    text; repeated rows are one component; each row with a null or wordless text is a component of its own and stays.
    """
    from .jaccard import jaccard_components

    keyed = with_row_key(docs, "near-rows")
    part = jaccard_components(keyed.select(ROW, "text"), key=ROW).select(F.col(ROW).alias("__r"), F.col("component_id").alias("__part"))
    ids = keyed.select(F.col(ROW).alias("__i"), F.col("doc_id").alias("__d")).join(part, F.col("__i") == F.col("__r")).drop("__r")
    by_id = ids.groupBy("__part", "__d").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("__i"))
    first = by_id.groupBy("__part").agg(F.min(F.struct(F.col("__d").isNull().alias("none"), "__d", "n", "__i")).alias("m"))
    first = stage_table(first.select("__part", F.col("m.__d").alias("__d"), F.col("m.n").alias("n"), F.col("m.__i").alias("__i")), "near-first")
    lead = first.where("n = 1").select("__i")
    if first.where("n > 1").head(1):  # texts are compared only where rows of one component share its smallest doc_id
        lead = lead.unionByName(_first_of_tied(keyed, ids, first))
    return chosen(keyed, lead.withColumn("__n", F.lit(1))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _first_of_tied(keyed: DataFrame, ids: DataFrame, first: DataFrame) -> DataFrame:
    """The row (__i) of the smallest text and other columns, among those that share the smallest doc_id of a component."""
    tied = first.where("n > 1").select(F.col("__part").alias("p"), F.col("__d").alias("d"))
    tied = ids.join(tied, (F.col("__part") == F.col("p")) & F.col("__d").eqNullSafe(F.col("d"))).select("__i", "__part")
    order = F.struct("text", *[f"`{c}`" for c in keyed.columns if c not in ("doc_id", "text", ROW)], ROW)
    tied = stage_table(tied, "near-tied")
    texts = chosen(keyed, tied.select("__i", F.lit(1).alias("__n"))).drop("__n")
    return texts.join(tied, F.col(ROW) == F.col("__i")).groupBy("__part").agg(F.min(order).alias("m")).select(F.col("m." + ROW).alias("__i"))


def dedup_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that stand elsewhere too; characters cut by a span's edge go with it.

    Cases: a null text becomes empty; repeated rows are copies of each other; extra columns pass through, whatever
    their names; n_chars, if there is one, is counted anew."""
    from .suffix import remove_repeats

    out = remove_repeats(but_text(docs), keep=("__rest",))
    new = {"text": F.col("kept_text"), **({"n_chars": F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return out.select(*[new.get(c, F.col(f"__rest.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, whatever its doc_id.

    Cases: a null text takes no words and goes; a null source is a source; repeated rows and ids are rows of their
    own; extra columns pass through, whatever their names."""
    keyed = with_row_key(docs, "mix-rows")
    copies = mix_sources(keyed.select(ROW, "doc_id", "source", "text"), row=ROW).select(F.col(ROW).alias("__i"), F.col("copies").alias("__n")).where("__n > 0")
    out = chosen(keyed, copies)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__copy")).drop("__copy")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of every text; a null text has none, rows come as they are."""
    import public_tokenizers

    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=("doc_id", "source"))
