"""One registered query for each corpus operator, over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.llm import (alignment, bpe, decontaminate, embedding_dedup, hard_negatives, langid, language_model, licenses, line_dedup,
                           simhash, substring_dedup, token_counts, warc)
from crateflow.llm.common import written
from crateflow.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file; the byte-level one is what most registered queries use."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = """
WITH pages AS (
  SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), totals AS (
  SELECT source, count(*) AS total FROM documents WHERE source IS NOT NULL GROUP BY source
), carried AS (
  SELECT source, unnest(list_distinct(list_transform(list_filter(lines, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''), lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM pages
), boilerplate AS (
  SELECT c.source, list(c.line) AS gone
  FROM (SELECT source, line, count(*) AS n FROM carried GROUP BY source, line HAVING count(*) >= 3) c
  JOIN totals t ON t.source = c.source WHERE CAST(c.n AS DOUBLE) / t.total > 0.1 GROUP BY c.source
), marked AS (
  SELECT doc_id, lines, coalesce(gone, []) AS gone FROM pages LEFT JOIN boilerplate b ON b.source = pages.source
)
SELECT doc_id, CAST(len(list_filter(lines, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS BIGINT) AS n_lines,
       CAST(len(list_filter(lines, lambda x: list_contains(gone, trim(x, ' ' || chr(9) || chr(13))))) AS BIGINT) AS n_dropped,
       sha256(array_to_string(list_filter(lines, lambda x: NOT list_contains(gone, trim(x, ' ' || chr(9) || chr(13)))), chr(10))) AS kept_sha256
FROM marked"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs, where=~langid.held_out())
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents"), licenses.known_table(spark))
    return out.select("doc_id", "text_license", F.array_join("notices", ",").alias("notices"), "n_notices")


def _op3_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in licenses.KNOWN)
    spell = ", ".join(f"{quote(a)}: {quote(b)}" for a, b in licenses.EQUIVALENT.items())
    words = (r"trim(regexp_replace(regexp_replace(lower({0}), '(?m)^[ \t]*(copyright\b|\(c\)|\x{{a9}})[^\n]*$', ' ', 'g'), "
             r"'[^\p{{L}}\p{{N}}]+', ' ', 'g'))")
    form = ("array_to_string(list_transform(string_split(" + words
            + ", ' '), lambda w: coalesce(element_at(spell.m, w)[1], w)), ' ')")
    return f"""
WITH spell AS (SELECT MAP {{{spell}}} AS m),
known AS (
  SELECT form, min(id) AS license_id FROM (SELECT id, {form.format("k.t")} AS form FROM (VALUES {known}) k(id, t), spell)
  WHERE form <> '' GROUP BY form
), units AS (
  SELECT doc_id, true AS whole, text AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL
), hits AS (
  SELECT u.doc_id, u.whole, k.license_id FROM (SELECT doc_id, whole, {form.format("unit")} AS form FROM units, spell) u
  JOIN known k ON k.form = u.form
)
SELECT d.doc_id, min(h.license_id) FILTER (WHERE h.whole) AS text_license,
       coalesce(array_to_string(list_sort(list_distinct(list(h.license_id) FILTER (WHERE NOT h.whole))), ','), '') AS notices,
       count(h.license_id) FILTER (WHERE NOT h.whole) AS n_notices
FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id GROUP BY d.doc_id"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), places AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS seq
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM words WHERE len(ws) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS nth FROM places)
  WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS at FROM later
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.at) AS txt, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM words) w
  ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.at = w.at
  GROUP BY w.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id"""


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), min_cosine=0.9)


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), part AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a
)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN part USING (vec_id) LEFT JOIN degree USING (vec_id)"""


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=2)
    return out.select("doc_id", "fingerprint", "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    found = warc.payloads(warc.reassemble(warc.read_records(spark, path)))
    meta = written(found.where("complete").select("record_id", "warc_type", "refers_to", "page_id", "payload_bytes",
                                                  "payload_sha1", "copies"), "warc-index")
    target = (meta.where("warc_type = 'response'").groupBy(F.col("record_id").alias("target"))
              .agg(F.min("page_id").alias("target_page"), F.min("payload_bytes").alias("target_bytes")))
    out = meta.join(target, (F.col("warc_type") == "revisit") & (F.col("refers_to") == F.col("target")), "left")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "page_id", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"),
        F.col("payload_sha1").alias("payload_digest"), F.col("warc_type").alias("record_type"),
        F.col("target_page").alias("refers_to"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), kept AS (
  SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS NOT NULL AND page_id <> keeper THEN keeper END AS refers_to
FROM p LEFT JOIN kept k ON k.payload_digest = p.payload_digest"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "item_words", "matched", "coverage")


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])
    return out.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets three edits that follow from its own text: an insertion, a deletion, a replacement."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    state = token_counts.index(docs, tokenizer_path()).withColumnRenamed("n_tokens", "n_tokens_before")
    size = F.length("text")
    edit = lambda start, stop, insert: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"),
                                                insert.alias("insert"))
    middle, quarter = F.floor(size / 2), F.floor(size / 4)
    edits = F.array(edit(middle, middle, F.upper(F.substring("text", 1, 25))), edit(quarter, quarter + 15, F.lit("")),
                    edit(size - 12, size - 2, F.concat(F.lit(" "), F.substring("text", 3, 9))))
    out = token_counts.apply_edits(state.withColumn("edits", F.when(F.col("text").isNotNull(), edits)), tokenizer_path())
    return out.select("doc_id", "n_tokens_before", F.col("n_tokens").alias("n_tokens_after"),
                      F.length("text").cast("bigint").alias("n_chars_after"), "reencoded_chars",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id has CRC-32 2 modulo 7 are held out from learning."""
    return language_model.score(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups").isNull(), "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; ids divisible by 7 get the next label of ten first."""
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS alike, c.vec_id, CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.q) = len(c.q)
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT alike
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_language_id": op2_language_id,
        "op3_license_scan": op3_license_scan,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_warc": op7_warc,
        "op8_decontamination": op8_decontamination,
        "op9_bpe_encode_decode": op9_bpe_encode_decode,
        "op10_token_counts": op10_token_counts,
        "op11_language_model": op11_language_model,
        "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL,
        "op3_license_scan": _op3_sql(),
        "op4_substring_dedup": OP4_SQL,
        "op5_embedding_near_dedup": OP5_SQL,
        "op7_warc": OP7_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
