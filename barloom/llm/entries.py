"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chat, decontaminate, embeddings, fill_middle, langid, licenses, lines, mixing, secret_scan, sharding, simhash, toxicity, whitening
from barloom.llm.common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        simhash.hex_digits(F.col("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the lines of every document that fuzzy deduplication keeps."""
    found = lines.kept_lines(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_lines",
        F.size("kept").cast("long").alias("n_kept"),
        F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept_lines"),
    )


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, fitted on those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = langid.identify(docs, train=~held, held=held)
    return found.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "lang_pred", "score")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among those of its label."""
    found = embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.93)
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license texts and notices that documents hold."""
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    marks = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(marks).alias("text")) for i, r in enumerate(("user", "assistant"))])),
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_turns(chat.canonical_turns(chat.rows_to_records(rows)))
    back = done.select(
        F.col("id").alias("conv_id"),
        "formatted",
        chat.read_back(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    found = mixing.mix(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets that documents hold, without their values."""
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents"), secret_scan.example_findings(spark))
    # the values themselves stay out of the report
    return found.select(
        F.col("id").alias("doc_id"), "first_char", "length", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    found = sharding.shard(read(spark, sf_dir, "documents"), shards=40)
    return found.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    found = decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened coordinates of every vector, one a row."""
    rows, fit, error = whitening.whiten(read(spark, sf_dir, "embeddings"))
    shares = F.lit(fit.explained if fit else []).cast("array<double>")
    each = rows.select(F.col("id").alias("vec_id"), "n", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from labelled ones that are not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = toxicity.score_toxicity(docs, labels, train=~held)
    return found.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and digests of every document cut for infilling, and of the text made from it again."""
    found = fill_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_simhash, op2_lines, op3_langid, op4_embeddings, op5_licenses, op6_chat, op7_mixing, op8_secrets, op9_sharding, op10_decontaminate,
        op11_whitening, op12_toxicity, op13_fill_middle,
    )
    return {f.__name__: f for f in every}


def _escaped_length(column: str) -> str:
    """DuckDB SQL for the number of characters of an escaped text."""
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}' || chr(92) || '{control[1:]}')"
    return f"length({out})"


def oracle_sql() -> dict[str, str]:
    marks = "</s>[INST] ok [/INST]"
    turn_chars = len(chat.OPEN) + len(chat.CLOSE) + 2
    return {
        "op6_chat": f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{marks}'), (-7, 1, 'assistant', '{marks}')
)
select conv_id,
       count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum({_escaped_length("role")} + {_escaped_length("text")} + {turn_chars}) as bigint) as formatted_chars
from said group by conv_id
"""
    }
