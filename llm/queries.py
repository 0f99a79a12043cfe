"""Queries and SQL of this package, for ``__spark_entry__.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.url_filter import judge

    return judge(_table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.va_search import scaled, top_k

    vectors = scaled(_table(spark, sf_dir, "embeddings"))
    found = top_k(vectors, vectors.where(F.col("id") % 20 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.toxicity import fit, held_out, score

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels.where(~held_out(F.col("doc_id")))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.line_dedup import dedup_lines

    cleaned = dedup_lines(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.mixture_sampling import mix

    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.substring_dedup import remove_repeats

    cut = remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.simhash_golay import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.rule_cascade import judge

    judged = judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from llm.best_fit_packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from llm.chat_format import format_conversations, read_back

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return read_back(format_conversations(rows.unionByName(extra), path))


def _damaged(rows: DataFrame) -> DataFrame:
    """Conversations with one kind of damage or none to each turn, by a checksum of its id and number; null values are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    row = F.struct(F.when(kind == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"))
    times = F.when(kind == 0, F.array().cast("array<struct<role:string,text:string>>")).when(kind == 3, F.array(row, row)).otherwise(F.array(row))
    return rows.select("conv_id", "turn", F.inline(times))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.conversation_repair import repair

    rows = _table(spark, sf_dir, "conversations")
    return repair(_damaged(rows), rows.select("conv_id"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.whitening import whiten

    white = whiten(_table(spark, sf_dir, "embeddings"))
    return white.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from llm._common import discard, join_counted, materialize, shared_folder
    from llm.warc import assemble, read_warc, write_warc

    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(_table(spark, sf_dir, "pages"), path)
    records = materialize(read_warc(spark, path).drop("payload", "headers", "http_headers"), "records")
    took = F.explode("metadata").alias("about")
    captures = assemble(records).where("capture is not null").select("record_id", "capture.type", "capture.refers_to", "capture.payload_bytes", "capture.payload_digest", took)
    rows = materialize(captures.withColumn("page_id", F.col("about.fields")["page_id"].cast("long")).drop("about"), "captures")
    discard(records)
    meant = rows.where("refers_to is not null").groupBy("refers_to").agg(F.count("*").alias("rows"))
    named = rows.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.min("page_id").alias("response_id"))
    told = join_counted(rows, materialize(meant.join(named, "refers_to"), "responses"), ["refers_to"], "rows", how="left", salt=F.xxhash64("record_id"))
    return told.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("response_id").alias("refers_to"))


def queries() -> dict:
    found = (op1_url_filter, op2_top_k, op3_toxicity, op4_line_dedup, op5_mixture, op6_substring_dedup, op7_simhash, op8_quality, op9_packing, op10_chat_format, op11_conversation_repair, op12_whitening, op13_warc)
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BARE = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

#: DuckDB's SQL of the queries that it can express. Learnt verdicts, tokenizers' ids, XXH64 and neighbourhoods of lines are beyond it.
SQL = {
    "op2_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
    "op5_mixture": f"""WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, -ln((CAST('0x' || substr(md5('5:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)
 / (0.1 + 0.9 * length(regexp_replace({_BARE}, '[#*$%&|<>!]', '', 'g')) / greatest(length({_BARE}), 1)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level FROM w
 WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS share FROM l),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(share * weight, cap)) AS target FROM h),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole, target - whole * source_size AS rest FROM t),
p AS (SELECT d.*, source_size, target, whole, rest, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((whole + CASE WHEN upto <= rest OR upto - rest < rest - (upto - size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM p""",
    "op6_substring_dedup": f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT r, doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 48))) AS i FROM t)),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h), g AS (SELECT r, i FROM x JOIN f USING (h) WHERE first < doc_id),
c AS (SELECT DISTINCT r, i + unnest(range(50)) AS i FROM g), n AS (SELECT r, count(*) AS n FROM c GROUP BY r),
k AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t) ANTI JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN n USING (r) LEFT JOIN k USING (r)""",
    "op8_quality": f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
g AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 1))) AS i FROM t)),
u AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1), c AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + unnest(range(3)) AS i FROM u) GROUP BY r),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS own, CAST(len(own) - len(list_distinct(own)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS lines,
 length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g')) AS letters FROM t LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (base_failed OR n_symbols * 4 > n_words OR word_chars > 25 * n_words OR word_chars < 2 * n_words
 OR (n_dup_lines >= 4 AND n_dup_lines * 2 > lines) OR upper * 2 > letters OR letters * 2 < word_chars) AS kept FROM s""",
    "op10_chat_format": """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(role, '\\', '\\\\'), '<', '\\l')) + length(replace(replace(text, '\\', '\\\\'), '<', '\\l')) + length('<|turn|><|text|><|end|>') AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op13_warc": """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id > first OR page_id IS NULL AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN record_type = 'revisit' THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
