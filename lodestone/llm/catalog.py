"""The subpackage's queries, with SQL where it can state the same result over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import leakage, mixing, provenance, residue, secrets, splitting, syntax, vectors
from lodestone.sources.tables import table


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    """(key, content) of both tables that hold indexed text; key is the table's name, a tab and the id."""
    parts = [
        table(spark, folder, t, "id", "content").where("content is not null").select(F.concat(F.lit(t + "\t"), F.col("id")).alias("key"), "content")
        for t in ("code_chunks", "chunks")
    ]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(tab, chunk_id, line_no): lines on which the value of a usable secret begins."""
    hits = secrets.scan_secrets(_contents(spark, folder), "key", "content")
    part = F.split("id", "\t", 2)
    return hits.select(part[0].alias("tab"), part[1].alias("chunk_id"), "line_no")


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """(tab, chunk_id, content): a copy of each content in which every secret is masked and all else is unchanged."""
    part = F.split("key", "\t", 2)
    masked = secrets.redact_secrets(_contents(spark, folder), "content")
    return masked.select(part[0].alias("tab"), part[1].alias("chunk_id"), "content").distinct()


def p3_foreign(spark: SparkSession, folder: str) -> DataFrame:
    """(path, repo, ext, kind, evidence) of scanned files that weren't written by hand in this project."""
    return provenance.find_foreign(table(spark, folder, "scanned_files"), table(spark, folder, "code_chunks", "filepath", "startline", "content"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(path): scanned files that a tool wrote, that were minified or copied in, or that are data in the guise of code."""
    return p3_foreign(spark, folder).select("path").distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """(id, neighbour, rank, similarity): the five most similar other records of every usable vector."""
    return vectors.top_k_neighbours(table(spark, folder, "chunks", "id", "vector"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(id_a, id_b): unordered pairs of which one is among the five most similar of the other."""
    near = p4_neighbours(spark, folder)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p4_recall(spark: SparkSession, folder: str) -> DataFrame:
    """(queries, true_neighbours, found, recall): what the search's output reaches against brute force."""
    chunks = table(spark, folder, "chunks", "id", "vector")
    return vectors.measured_recall(chunks, vectors.top_k_neighbours(chunks))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    src = table(spark, folder, "code_chunks", "id", "content", "startline", "filepath").where(F.length("content") > 2000 * splitting.TOKEN_CHARS)
    src = src.withColumnRenamed("startline", "first_line").withColumnRenamed("id", "chunk_id")
    return splitting.split_items(src, "content", "first_line", 2000, 50, path="filepath")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of at most 2,000 tokens of every oversized chunk, with an overlap of 50 tokens."""
    return _pieces(spark, folder).dropDuplicates(["chunk_id", "piece_no", "n_pieces", "core_start", "content"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id): the chunks that are cut, into several pieces within the limit whose cores cover them without a gap."""
    p = _pieces(spark, folder).select("chunk_id", "piece_no", "n_pieces", "core_start", "core_end", "n_tokens").distinct()
    whole = p.groupBy("chunk_id").agg(F.max("n_pieces").alias("n"), F.max("n_tokens").alias("most"), F.max("core_end").alias("chars"), F.sum(F.col("core_end") - F.col("core_start")).alias("covered"))
    return whole.where("n > 1 and most <= 2000 and covered >= chars").select("chunk_id")


def p5_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, pieces_fit, hash): each oversized chunk put together again from its cores, and whether its pieces keep the limit."""
    core = F.struct("piece_no", F.expr("substr(content, overlap_chars + 1)").alias("core"))
    p = p5_pieces(spark, folder).groupBy("chunk_id").agg(F.sort_array(F.collect_list(core)).alias("cores"), (F.max("n_tokens") <= 2000).alias("pieces_fit"))
    return p.select("chunk_id", "pieces_fit", F.sha2(F.array_join(F.transform("cores", lambda c: c["core"]), ""), 256).alias("hash"))


def p6_judged(spark: SparkSession, folder: str) -> DataFrame:
    """(path, repo, language, ext, judged, cause, line) of each scanned file in a language that has a grammar."""
    return syntax.judge_files(table(spark, folder, "scanned_files"), table(spark, folder, "code_chunks", "filepath", "startline", "content"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(path): scanned files that break the grammar of their extension's language."""
    return p6_judged(spark, folder).where("cause is not null").select("path")


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, language, files, invalid, rate)."""
    return syntax.rates(p6_judged(spark, folder))


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id, words, distance, item_chars, passage) also of passages with up to five edits in each 100 characters."""
    return leakage.find_leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"), edits=5, q=12, min_chars=100)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id): documents that share 13 or more consecutive words with an item."""
    return leakage.find_leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text")).select("doc_id", "item_id")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "mix_targets"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, tokens, repeats): the documents of the mix."""
    return _mix(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """(source, target_share, max_repeats, reached_share, tokens, documents, uses)."""
    return _mix(spark, folder)[1]


def p9_residue(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, kind, evidence_words, content_words) of documents without real content."""
    return residue.find_residue(table(spark, folder, "documents", "doc_id", "text", "repo")).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id): documents without real content."""
    return p9_residue(spark, folder).select("doc_id").distinct()


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that remain, null and blank texts included, without redelivered rows."""
    docs = table(spark, folder, "documents").distinct()
    return docs.join(p9_found(spark, folder), "doc_id", "left_anti").select("doc_id", "lang", "source", "repo", F.length("text").alias("chars"))


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p3_found": p3_found,
    "p3_foreign": p3_foreign,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p4_recall": p4_recall,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_rejoined": p5_rejoined,
    "p6_found": p6_found,
    "p6_judged": p6_judged,
    "p6_rates": p6_rates,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_residue": p9_residue,
    "p9_kept": p9_kept,
}

ORACLES = {
    "p4_found": """
        WITH v AS (SELECT DISTINCT ON (id) id, list_transform(vector, lambda x: x::DOUBLE)::DOUBLE[384] AS v FROM chunks
            WHERE len(vector) = 384 AND list_bool_and(list_transform(vector, lambda x: isfinite(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0))),
        s AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY round(array_cosine_similarity(a.v, b.v), 12) DESC, b.id) AS rn FROM v a JOIN v b ON a.id <> b.id)
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM s WHERE rn <= 5""",
    "p5_found": "SELECT DISTINCT id AS chunk_id FROM code_chunks WHERE length(content) > 8000",
    "p5_rejoined": "SELECT DISTINCT id AS chunk_id, TRUE AS pieces_fit, sha256(content) AS hash FROM code_chunks WHERE length(content) > 8000",
    "p7_found": """
        WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS r(i)),
        eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM e, unnest(range(1, len(w) - 11)) AS r(i))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
}
