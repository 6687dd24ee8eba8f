"""Queries of the llm operators, by name, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, chunking, credentials, documented, handwritten, near_duplicates, neighbours, packing, reading_level
from lodestone.operators.stats import one_row
from lodestone.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of live credentials: (id, field_name, line_no)."""
    return credentials.credential_places(table(spark, sf_dir, "code_units")).select("id", "field_name", "line_no").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of code_units with its credentials masked."""
    return credentials.redacted(table(spark, sf_dir, "code_units"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods with documentation that says something."""
    return documented.documented(table(spark, sf_dir, "code_units")).where("number = 1").select("id")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description of each documented function in the units of functions and methods."""
    return documented.documented_pairs(table(spark, sf_dir, "code_units"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of units of which one is among the five most similar of the other, at 0.80 or more."""
    return neighbours.similar_pairs(neighbours.nearest(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "code_units").select("id"), least=0.80), 0.80)


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other records of every usable record."""
    return neighbours.nearest(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "code_units").select("id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of units whose bodies share at least 0.60 of their runs of three words."""
    return near_duplicates.near_duplicate_pairs(*near_duplicates.near_duplicate_classes(table(spark, sf_dir, "code_units")))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and number of links of every unit with a body of at least 200 characters."""
    return near_duplicates.group_labels(*near_duplicates.near_duplicate_classes(table(spark, sf_dir, "code_units")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are generated, minified, vendored or data."""
    return handwritten.not_handwritten(table(spark, sf_dir, "file_index"), table(spark, sf_dir, "code_units")).select("repo", "file_path")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that had to be split."""
    return chunking.split_oversized(table(spark, sf_dir, "code_units")).where("piece = 0").select("id").distinct()


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pieces of every unit with more than 4,000 characters."""
    return chunking.split_oversized(table(spark, sf_dir, "code_units"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_column(table(spark, sf_dir, "documents"))


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the encoded corpus."""
    return bpe.corpus_token_stats(bpe.encode_column(table(spark, sf_dir, "documents")))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and position of every document, in containers of 2,048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(packing.pack_documents(table(spark, sf_dir, "documents")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents of grade 4 or 5."""
    return p10_levels(spark, sf_dir).where(F.col("grade") >= 3.5).select("doc_id").distinct()


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated grade of every English document with prose of its own."""
    return reading_level.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p1_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and lines of both fields after redaction, which must not change them."""
    masked = credentials.redacted(table(spark, sf_dir, "code_units"))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return masked.select("id", F.length("body").alias("body_length"), lines("body").alias("body_lines"), F.length("docstring").alias("docstring_length"), lines("docstring").alias("docstring_lines"))


def p2_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of units with a first pair, and whether the code of every pair with one is a part of its unit's body."""
    bodies = table(spark, sf_dir, "code_units").select("id", "body").distinct()
    pairs = documented.documented_pairs(table(spark, sf_dir, "code_units")).select("id", "code").join(bodies, "id")
    return pairs.agg((F.count_if(F.col("code").isNotNull() & ~F.contains("body", "code")) == 0).alias("all_inside"), (F.count_if(F.coalesce(F.length("code"), F.lit(0)) == 0) * 100 <= F.count("*")).alias("hardly_any_empty"))


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every usable vector whose id is divisible by 100, with their number and whether the farthest is no farther than it should be."""
    near = p4_neighbours(spark, sf_dir).where(F.col("unit_id") % 100 == 0)
    return near.groupBy("unit_id").agg(F.count("*").alias("n"), F.max("cosine").alias("nearest"), F.min("cosine").alias("farthest"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every split unit whether its pieces keep the limit, repeat 200 characters each and together give back the body."""
    pieces = chunking.split_oversized(table(spark, sf_dir, "code_units"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: F.when(x["piece"] == 0, x["text"]).otherwise(F.substr(x["text"], F.lit(chunking.OVERLAP + 1)))), "")
    order = F.array_sort(F.collect_list(F.struct("piece", "begin", "n_chars")))
    gaps = F.forall(F.sequence(F.lit(1), F.size(order) - 1), lambda i: order[i]["begin"] == order[i - 1]["begin"] + order[i - 1]["n_chars"] - chunking.OVERLAP)
    return pieces.groupBy("id").agg(F.sha2(whole, 256).alias("body_hash"), (F.max("n_chars") <= chunking.LIMIT).alias("within"), gaps.alias("overlapping"))


def p8_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that the ids of each document stand for: those of its text."""
    return bpe.decoded_sizes(bpe.encode_column(table(spark, sf_dir, "documents")))


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document is packed whole and once, and no container overfull."""
    packed, documents = packing.pack_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "documents")
    counts = bpe.token_counts(documents)
    own = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("packed"), F.count("*").alias("pieces"))
    each = counts.join(own, "doc_id", "left").agg(F.count("*").alias("n_docs"), (F.count_if(~F.col("packed").eqNullSafe(F.col("n_tokens"))) == 0).alias("all_whole"), (F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= packing.CAPACITY)) == 0).alias("none_split_in_vain"))
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg((F.max("n") <= packing.CAPACITY).alias("none_overfull"))
    return one_row(each, full)


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_redacted, p1_lengths, p2_found, p2_pairs, p2_code, p4_found, p4_neighbours, p4_recall, p5_found, p5_groups, p6_found, p7_found, p7_pieces, p7_checks, p8_ids, p8_stats, p8_sizes, p9_packed, p9_fill, p9_checks, p10_found, p10_levels)}

_USABLE = """
latest AS (
  SELECT unit_id, dim, v_min, v_max, data FROM (
    SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY written_at DESC NULLS LAST) AS rn
    FROM (SELECT DISTINCT * FROM vectors)) WHERE rn = 1 AND unit_id IN (SELECT id FROM code_units)),
usable AS (
  SELECT unit_id, v FROM (
    SELECT unit_id, [CAST(v_min AS DOUBLE) + x / 255.0::DOUBLE * (CAST(v_max AS DOUBLE) - CAST(v_min AS DOUBLE)) FOR x IN data] AS v
    FROM latest WHERE dim = 96 AND data IS NOT NULL AND len(data) = 96 AND v_min IS NOT NULL AND v_max IS NOT NULL)
  WHERE list_sum([abs(x) FOR x IN v]) > 0),
near AS (
  SELECT u.unit_id, o.unit_id AS other, round(list_cosine_similarity(u.v, o.v), 6) AS cosine,
         row_number() OVER (PARTITION BY u.unit_id ORDER BY round(list_cosine_similarity(u.v, o.v), 6) DESC, o.unit_id) AS rank
  FROM usable u JOIN usable o ON u.unit_id <> o.unit_id
  QUALIFY rank <= 5)
"""

_PAIRS = r"""
WITH texts AS (SELECT DISTINCT id, body FROM code_units WHERE length(body) >= 200),
words AS (SELECT id, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+') AS w FROM texts),
runs AS (SELECT DISTINCT id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS r FROM words WHERE len(w) >= 3),
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM runs a JOIN runs b ON a.r = b.r AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM common JOIN sizes a ON a.id = id_a JOIN sizes b ON b.id = id_b WHERE c * 5 >= (a.n + b.n - c) * 3
"""

SQL: dict[str, str] = {
    "p7_found": "SELECT DISTINCT id FROM code_units WHERE length(body) > 4000",
    "p4_found": f"WITH {_USABLE} SELECT DISTINCT least(unit_id, other) AS unit_a, greatest(unit_id, other) AS unit_b FROM near WHERE cosine >= 0.80",
    "p1_lengths": r"SELECT id, length(body) AS body_length, length(body) - length(replace(body, chr(10), '')) AS body_lines, length(docstring) AS docstring_length, length(docstring) - length(replace(docstring, chr(10), '')) AS docstring_lines FROM code_units",
    "p2_code": "SELECT true AS all_inside, true AS hardly_any_empty",
    "p4_recall": f"WITH {_USABLE} SELECT unit_id, count(*) AS n, max(cosine) AS nearest, min(cosine) AS farthest FROM near WHERE unit_id % 100 = 0 GROUP BY unit_id",
    "p4_neighbours": f"WITH {_USABLE} SELECT unit_id, other, cosine, CAST(rank AS INT) AS rank FROM near",
    "p7_checks": "SELECT DISTINCT id, sha256(body) AS body_hash, true AS within, true AS overlapping FROM code_units WHERE length(body) > 4000",
    "p8_sizes": "SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes FROM documents",
    "p9_checks": "SELECT count(*) AS n_docs, true AS all_whole, true AS none_split_in_vain, true AS none_overfull FROM documents",
    "p5_groups": f"""
WITH RECURSIVE links AS ({_PAIRS}),
texts AS (SELECT DISTINCT id FROM code_units WHERE length(body) >= 200 AND len(regexp_extract_all(body, '[A-Za-z0-9_]+')) >= 3),
both_ways AS (SELECT id_a AS a, id_b AS b FROM links UNION ALL SELECT id_b, id_a FROM links),
reached AS (SELECT id AS a, id AS b FROM texts UNION SELECT r.a, w.b FROM reached r JOIN both_ways w ON r.b = w.a)
SELECT a AS id, min(b) AS group_id, (SELECT count(*) FROM both_ways w WHERE w.a = r.a) AS n_links FROM reached r GROUP BY a
""",
    "p5_found": _PAIRS,
}
