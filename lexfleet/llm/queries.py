"""Named queries of the training-data operators, with production parameters."""

from pyspark.sql import functions as F

from lexfleet.llm import (
    byte_bpe, chat_links, common, contextual_pii, decontamination, embedding_near, hard_negatives, language_id, licence_scan, ngram_join, packing, periodic_runs,
    suffix_dedup, token_counts,
)

CONTEXT = 4096


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove(common.table(spark, sf_dir, "documents")).drop("spans")


def op2_language_id(spark, sf_dir):
    return language_id.identify(common.table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return token_counts.token_counts(common.table(spark, sf_dir, "documents"), CONTEXT)


def op4_ngram_join(spark, sf_dir):
    return ngram_join.join(common.table(spark, sf_dir, "documents"))


def op5_embedding_near(spark, sf_dir):
    return embedding_near.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark, sf_dir):
    return decontamination.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op7_contextual_pii(spark, sf_dir):
    return contextual_pii.find(common.table(spark, sf_dir, "documents"))


def op8_licence_scan(spark, sf_dir):
    return licence_scan.scan(common.table(spark, sf_dir, "documents"), wrapped=True).drop("matches")


# the tools that the turns of a conversation are written as
TOOLS = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}, "configure": {"text": ("string", True)}}


def tool_messages(turns):
    """Conversations as tool use: a user's turn calls `reply` after the call two turns
    before, the assistant's next turn is the result, a system turn calls `configure`."""
    call_id = lambda turn: F.concat_ws("-", F.lit("call"), "conv_id", turn)
    name = F.when(F.col("role") == "system", "configure").otherwise("reply")
    reply = F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn"))
    arguments = F.when(F.col("role") == "system", F.to_json(F.struct("text"))).otherwise(F.to_json(reply))
    after = F.when((F.col("role") == "user") & (F.col("turn") >= 2), F.array(call_id(F.col("turn") - 2)))
    call = F.struct(after.alias("after"), F.parse_json(arguments).alias("arguments"), call_id(F.col("turn")).alias("id"), name.alias("name"))
    answer = F.struct(F.col("text").alias("content"), call_id(F.col("turn") - 1).alias("tool_call_id"))
    is_answer = F.col("role") == "assistant"
    body = F.when(is_answer, F.to_json(answer)).otherwise(F.to_json(F.struct(F.array(call).alias("tool_calls"))))
    return turns.select("conv_id", "turn", F.when(is_answer, "tool").otherwise("assistant").alias("role"), body.alias("text"))


def op9_chat_links(spark, sf_dir):
    return chat_links.link(tool_messages(common.table(spark, sf_dir, "conversations")), TOOLS)


def op10_packing(spark, sf_dir):
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), tokens=CONTEXT)


def op11_hard_negatives(spark, sf_dir):
    rows = common.table(spark, sf_dir, "embeddings")
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(finite(x), F.floor(256 * x).cast("double")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", whole.alias("embedding"), label.alias("label")), F.col("vec_id") % 50 == 0)


def repeated_tail(ident, text):
    """Of about every tenth text the words, where those from one place on repeat a period
    that the id decides, joined by one space; other texts as they are."""
    h = F.crc32(ident.cast("string").cast("binary"))

    def edited(words):
        n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
        at = g % n
        period = 1 + F.floor((n - at) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < at, w).otherwise(F.get(words, (at + (i - at) % period).cast("int")))), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # the words are bound once: inside the lambda they would be cut for every word
    tail = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, edited(w)).otherwise("")), F.lit(0))
    return F.when(h % 10 == 0, tail).otherwise(text)


def op12_periodic_runs(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.find(docs).withColumn("top", periodic_runs.longest_run(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    length = -F.col("top.less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.expr("1000 * -top.less div top.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_byte_bpe(spark, sf_dir):
    ids = byte_bpe.encode(common.table(spark, sf_dir, "documents"))
    back = byte_bpe.decode(ids, keep=("doc_id", "ids"))
    return back.select("doc_id", byte_bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_token_counts, op4_ngram_join, op5_embedding_near, op6_decontamination, op7_contextual_pii, op8_licence_scan, op9_chat_links, op10_packing, op11_hard_negatives, op12_periodic_runs, op13_byte_bpe)}
SQL = {"op8_licence_scan": licence_scan.oracle()}
