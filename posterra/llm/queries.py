"""The numbered operators with production parameters over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, langid, packing, pieces, pii, quality, repair, runs, suffixes, tokens, topk, urls
from .session import checkpointed


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_repeated", "n_cut", "repeated_spans", "cut_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after an edit in the middle of each document and one at its start."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = F.floor(F.length("text") / 2).cast("int")
    edit = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), F.lit(new).alias("replacement"))
    edits = F.array(edit(middle, middle + 12, " an edited passage "), edit(F.lit(0), F.lit(1), ""))
    return tokens.count(docs, edits=edits)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids, and says whether the text came back."""
    rows = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_pieces"), "ids_sha256", F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents")).drop("text_hash")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says the control strings, formatted and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.formatted(turns.unionByName(more)))


def damaged(turns: DataFrame) -> DataFrame:
    """The damage that op12 mends: by the checksum of its place a row is dropped, emptied, stripped of stops, repeated or said by the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the damage: its faults, its cheapest edits and what they make of it."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = damaged(given)
    audits = checkpointed(repair.audited(turns))
    shas = repair.digests(repair.repaired(turns, audits))
    # three tables of a row a conversation, put side by side
    sides = given.select("conv_id", *[F.lit(None).cast(t).alias(n) for n, t in [*audits.dtypes[1:], *shas.dtypes[1:]]])
    for part in (audits, shas):
        sides = sides.unionByName(part, allowMissingColumns=True)
    zero = [F.coalesce(F.max(n), F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    text = [F.coalesce(F.max(n), d).alias(n) for n, d in (("audit", F.lit("")), ("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))]
    return sides.groupBy("conv_id").agg(*zero, *text)


def planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the checksum of its key, with its words from one on repeated periodically."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    moved = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", (a + (i - a) % p).cast("int"))))
    rows = docs.select("doc_id", "text", F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("words"))
    return rows.select("doc_id", F.when(F.size("words") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of all documents, a tenth of which are made periodic."""
    found = runs.find(planted_periods(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.when(F.size("runs") > 0, runs.strongest(F.col("runs")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    top = [F.col("best")[n].alias(n) for n in ("start", "length", "period")]
    return found.select("doc_id", "n_runs", *top, F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 counts, which SQL can say."""
    return suffixes.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_repeated", "n_cut")


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3's base kinds count."""
    return pii.find(_table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's hosts, paths and rules."""
    rows = urls.judge(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's base counts."""
    return quality.assess(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that op10 packs, each in one bin that holds it."""
    rows = packing.best_fit(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "piece", F.col("n_words").cast("long").alias("n_words"), (F.col("bin_offset") + F.col("n_words") <= F.col("capacity")).alias("fits"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_suffix_array_dedup, op2_token_counts, op3_pii, op4_ngram_jaccard_join, op5_language_id, op6_sentencepiece,
        op7_exact_top_k, op8_url_filter, op9_quality_rules, op10_best_fit_packing, op11_chat_format, op12_conversation_repair, op13_periodic_runs, pipeline,
        repeated_words, personal_data_counts, url_rules, quality_counts, packed_words,
    )
    return {f.__name__: f for f in own}
