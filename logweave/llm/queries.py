"""One query per operator: the operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.decontaminate import leaks
from logweave.llm.exact_dedup import exact_groups
from logweave.llm.fill_in_middle import fill_in_middle, restored
from logweave.llm.hard_negatives import hard_negatives
from logweave.llm.language_id import identify
from logweave.llm.lm_score import score_texts
from logweave.llm.mixing import mix_sources
from logweave.llm.registry import ORACLES, QUERIES, query, table
from logweave.llm.secrets import KINDS, find_secrets, span_text
from logweave.llm.simhash import simhash_groups
from logweave.llm.substring import remove_repeats
from logweave.llm.token_files import token_output
from logweave.llm.toxicity import score_documents
from logweave.llm.warc import archive_pages

__all__ = ["ORACLES", "QUERIES"]


def byte_bpe_50k() -> str:
    """Place of the tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5)


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), folds=5)


@query("op3_lm_score")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), folds=10)


@query(
    "op4_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    bits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", bits.alias("fingerprint"), "component_id")


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), byte_bpe_50k(), end_id=2)


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), owner_col="source", repo_col="doc_id", example_owners=3)
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("token"))

    def of_kind(k: int) -> Column:
        # The kind is bound here: a second parameter of the lambda would be the span's place in the array.
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


@query(
    "op10_source_mix",
    """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         (('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '~' || md5(coalesce(text, '')))), 1, 12))::UBIGINT
          ::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 2 AS cap,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM s
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
th AS (SELECT min_by(level, cap / weight) AS theta FROM l WHERE level <= cap / weight),
t AS (
  SELECT source, source_size, CASE WHEN theta IS NULL THEN cap ELSE least(cap, theta * weight) END AS target,
         CASE WHEN source_size > 0
              THEN floor((CASE WHEN theta IS NULL THEN cap ELSE least(cap, theta * weight) END) / source_size)
              ELSE 0 END::BIGINT AS whole
  FROM l, th),
r AS (SELECT *, target - whole * source_size AS rest FROM t),
z AS (
  SELECT source, size, rest, (rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(n * size::DOUBLE * size) OVER (PARTITION BY source ORDER BY size DESC
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM (SELECT d.source, size, rest, count(*) AS n FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
        WHERE size > 0 GROUP BY ALL)),
c AS (SELECT source, max_by(scale, size) AS scale FROM z WHERE scale >= 0 AND scale * size <= 1 GROUP BY source),
p AS (
  SELECT d.*, source_size, target, whole, rest,
         least(1.0, coalesce(c.scale, CASE WHEN rest > 0 THEN 1.0 ELSE 0.0 END) * size) AS pi
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source),
k AS (
  SELECT *, CASE WHEN pi >= 1 THEN 0.0 WHEN pi > 0 THEN u / (1.0 - u) * ((1.0 - pi) / pi) END AS rank FROM p),
o AS (
  SELECT *, sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, u) - size / 2 AS upto FROM k)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rank IS NOT NULL AND upto <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, seed=7)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query(
    "op11_hard_negatives",
    """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, positives=5, negatives=10, window=(30, 90, 100))


@query(
    "op12_warc",
    """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id,
         sha1(coalesce(html, '')) AS hex
  FROM pages)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(hex, (k // 8 * 10 + 1)::INT, 10))::UBIGINT >> (35 - k % 8 * 5)::UBIGINT) & 31) + 1)::INT, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_pages(table(spark, sf_dir, "pages"), least_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op13_fill_in_middle",
    """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         list_transform(range(4), lambda k: ('0x' || substr(sha256('1:' || doc_id), (8 * k + 1)::INT, 8))::UBIGINT::BIGINT) AS h
  FROM documents),
c AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a,
         greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90
              THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
s AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
         array_to_string(units[b + 1:], '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed="1", rate=90, spm_rate=20)
    sha = {"output_sha256": F.col("fim.output"), "restored_sha256": restored(F.col("fim.output"), F.col("fim.form"))}
    return made.select(
        "doc_id",
        *[F.col(f"fim.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        *[F.sha2(text.cast("binary"), 256).alias(name) for name, text in sha.items()],
    )
