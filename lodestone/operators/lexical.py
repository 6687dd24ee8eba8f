"""Lexical search: postings, field statistics and BM25 over four weighted fields.

A query is a small boolean language: words are alternatives, a word that holds several terms
(``process_payment``) and quoted text are phrases, ``+``/``AND`` require, ``-``/``NOT``
exclude, ``field:`` restricts, parentheses group. A malformed query is taken as plain words.

Scores are those of BM25 with exact field lengths; equal scores (to nine decimals) are
ordered by id. Null fields have no terms. An empty query finds nothing.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

K1, B = 1.2, 0.75
FIELDS = {"name": ("name", 3.0), "signature": ("full_signature", 2.0), "docstring": ("docstring", 1.0), "body": ("body", 1.0)}
OVER_FETCH = 5


# --- query language ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Clause:
    """One word or phrase: its terms in order, in all fields or in one."""

    terms: tuple[str, ...]
    field: str | None = None


@dataclass
class Query:
    """Leaves and how they combine: (op, children) with op of any, all, not or leaf."""

    clauses: list[Clause] = field(default_factory=list)
    tree: tuple = ("any", [])

    @property
    def terms(self) -> list[str]:
        return sorted({t for c in self.clauses for t in c.terms})


LEXEME = re.compile(r'\s*(?:(\()|(\))|([+\-!])(?=\S)|(?:(\w+):)?(?:"((?:[^"\\]|\\.)*)"|((?:[^\s()"\\]|\\.)+)))')


class Malformed(ValueError):
    pass


def parse_query(query: str) -> Query:
    try:
        return _parse(query)
    except Malformed:
        return _plain(query)


def _plain(query: str) -> Query:
    clauses = [Clause(tuple(t)) for w in query.split() if (t := tx.tokenize(w))]
    return Query(clauses, ("any", [("leaf", i) for i in range(len(clauses))]))


def _parse(query: str) -> Query:
    out = Query()
    at = 0
    lexemes = []
    while query[at:].strip():
        m = LEXEME.match(query, at)
        if not m or m.end() == at:
            raise Malformed(query)
        lexemes.append(m)
        at = m.end()
    lexemes.reverse()

    def group(depth: int) -> tuple:
        should: list = []
        must: list = []
        never: list = []
        conjunction = None
        while lexemes:
            m = lexemes.pop()
            if m.group(2):
                if not depth:
                    raise Malformed(query)
                break
            word = m.group(6)
            if word in ("AND", "OR") and not m.group(4):
                if conjunction or not (should or must or never):
                    raise Malformed(query)
                conjunction = word
                continue
            sign = m.group(3) or ("-" if word == "NOT" and not m.group(4) else None)
            if sign and (m.group(3) or word == "NOT"):
                if not lexemes:
                    raise Malformed(query)
                m = lexemes.pop()
            if m.group(1):
                node = group(depth + 1)
            else:
                if m.group(4) and m.group(4) not in FIELDS:
                    raise Malformed(query)
                text = m.group(5) if m.group(5) is not None else m.group(6)
                if text is None:
                    raise Malformed(query)
                terms = tuple(tx.tokenize(re.sub(r"\\(.)", r"\1", text)))
                if not terms:
                    conjunction = None
                    continue
                out.clauses.append(Clause(terms, m.group(4)))
                node = ("leaf", len(out.clauses) - 1)
            if sign in ("-", "!"):
                never.append(node)
            elif sign == "+":
                must.append(node)
            elif conjunction == "AND":
                if should:
                    must.append(should.pop())
                must.append(node)
            else:
                should.append(node)
            conjunction = None
        else:
            if depth:
                raise Malformed(query)
        if conjunction:
            raise Malformed(query)
        parts = [*must]
        if should and not must:
            parts.append(("any", should))
        extra = should if must else []
        return ("all", parts, never, extra)

    out.tree = group(0)
    return out


def _matches(node: tuple, hit: dict[int, Column]) -> Column:
    if node[0] == "leaf":
        return hit[node[1]]
    if node[0] == "any":
        found = F.lit(False)
        for child in node[1]:
            found = found | _matches(child, hit)
        return found
    _, parts, never, _extra = node
    found = F.lit(bool(parts))
    for child in parts:
        found = found & _matches(child, hit)
    for child in never:
        found = found & ~_matches(child, hit)
    return found


def _scored(node: tuple) -> list[int]:
    """Leaves that add to the score: all that aren't excluded."""
    if node[0] == "leaf":
        return [node[1]]
    if node[0] == "any":
        return [i for child in node[1] for i in _scored(child)]
    return [i for child in [*node[1], *node[3]] for i in _scored(child)]


# --- index ------------------------------------------------------------------------------------------------------


def field_terms(units: DataFrame) -> DataFrame:
    """(id, field, terms array<string>) of each field of each unit. No shuffle."""
    rows = F.array(*[F.struct(F.lit(name).alias("field"), tx.tokens(F.col(column)).alias("terms")) for name, (column, _) in FIELDS.items()])
    return units.select("id", F.explode(rows).alias("f")).select("id", "f.field", "f.terms")


def build_postings(units: DataFrame) -> DataFrame:
    """(term, field, id, positions array<int>, field_length int)."""
    rows = field_terms(units).select("id", "field", F.size("terms").alias("field_length"), F.posexplode("terms").alias("position", "term"))
    return rows.groupBy("term", "field", "id", "field_length").agg(F.array_sort(F.collect_list("position")).alias("positions")).select("term", "field", "id", "positions", "field_length")


def field_stats(units: DataFrame) -> DataFrame:
    """(field, n_units, mean_length)."""
    return field_terms(units).groupBy("field").agg(F.count("*").alias("n_units"), F.avg(F.size("terms")).alias("mean_length"))


def field_totals(units: DataFrame) -> DataFrame:
    """(field, n_units, n_terms): totals that add up over parts of the units."""
    return field_terms(units).groupBy("field").agg(F.count("*").alias("n_units"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).cast("bigint").alias("n_terms"))


def stats_of_totals(totals: DataFrame) -> DataFrame:
    """Field statistics from totals of all parts."""
    return totals.groupBy("field").agg(F.sum("n_units").alias("n_units"), (F.sum("n_terms") / F.sum("n_units")).alias("mean_length")).where("n_units > 0")


def write_postings(postings: DataFrame, path: str, partitions: int | None = None) -> None:
    """Postings sorted by term, so that a query's terms prune row groups by their statistics."""
    by_term = postings.repartitionByRange(partitions, "term") if partitions else postings.repartitionByRange("term")
    by_term.sortWithinPartitions("term", "field", "id").write.mode("overwrite").parquet(path)


def scores(postings: DataFrame, stats: DataFrame, query: Query) -> DataFrame:
    """(id, score) of every unit that matches. Only postings of the query's terms are read.

    Field statistics and the document frequencies of the query's terms, at most four rows a
    term, come to the driver first; the scoring itself is then one filtered scan, a broadcast
    of the query's terms and one aggregation by unit.
    """
    spark = postings.sparkSession
    if not query.clauses:
        return postings.select("id", F.lit(0.0).alias("score")).where("false")
    rows = postings.where(F.col("term").isin(query.terms))
    of_field = {r["field"]: (r["n_units"], r["mean_length"] or 0.0) for r in stats.collect()}
    df = {(r["field"], r["term"]): r["df"] for r in rows.groupBy("field", "term").agg(F.count("*").alias("df")).collect()}
    idf = {key: math.log(1 + (of_field[key[0]][0] - n + 0.5) / (n + 0.5)) for key, n in df.items()}
    placed, weight = [], []
    for i, c in enumerate(query.clauses):
        for name in FIELDS if c.field is None else [c.field]:
            if all((name, t) in idf for t in c.terms):
                weight.append((f"{i}|{name}", FIELDS[name][1] * sum(idf[(name, t)] for t in c.terms)))
                placed += [(i, n, t, len(c.terms), name) for n, t in enumerate(c.terms)]
    if not placed:
        return postings.select("id", F.lit(0.0).alias("score")).where("false")
    own = spark.createDataFrame(placed, "clause int, at int, term string, n_terms int, field string")
    found = rows.join(F.broadcast(own), ["term", "field"])
    hits = found.where("n_terms = 1").select("clause", "id", "field", "field_length", F.size("positions").alias("tf"))
    if any(len(c.terms) > 1 for c in query.clauses):
        phrases = (
            found.where("n_terms > 1")
            .select("clause", "id", "field", "field_length", "n_terms", "at", F.explode("positions").alias("position"))
            .groupBy("clause", "id", "field", "field_length", "n_terms", (F.col("position") - F.col("at")).alias("begin"))
            .agg(F.countDistinct("at").alias("there"))
            .where("there = n_terms")
            .groupBy("clause", "id", "field", "field_length")
            .agg(F.count("*").cast("int").alias("tf"))
        )
        hits = hits.unionByName(phrases)
    weights = F.create_map(*[x for key, w in weight for x in (F.lit(key), F.lit(w))])
    means = F.create_map(*[x for name, (_, mean) in of_field.items() for x in (F.lit(name), F.lit(float(mean)))])
    mean = means[F.col("field")]
    length = F.when(mean > 0, F.col("field_length") / mean).otherwise(0.0)
    part = weights[F.concat_ws("|", F.col("clause").cast("string"), F.col("field"))] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    by_clause = hits.select("clause", "id", part.alias("part")).groupBy("id").agg(*[F.sum(F.when(F.col("clause") == i, F.col("part"))).alias(f"c{i}") for i in range(len(query.clauses))])
    hit = {i: F.col(f"c{i}").isNotNull() for i in range(len(query.clauses))}
    total = F.lit(0.0)
    for i in sorted(set(_scored(query.tree))):
        total = total + F.coalesce(F.col(f"c{i}"), F.lit(0.0))
    return by_clause.where(_matches(query.tree, hit)).select("id", total.alias("score"))


def by_score(score: str = "score") -> list[Column]:
    return [F.round(F.col(score), 9).desc(), F.col("id").asc()]


def search(postings: DataFrame, stats: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, score) of the best ``limit`` units."""
    return scores(postings, stats, parse_query(query)).orderBy(*by_score()).limit(limit)


def _is_plain(tree: tuple) -> bool:
    """Whether a query is a list of alternatives and no more."""
    return tree[0] == "any" or tree[0] == "all" and len(tree[1]) == 1 and not tree[2] and not tree[3] and tree[1][0][0] == "any" and all(c[0] == "leaf" for c in tree[1][0][1])


def search_many(postings: DataFrame, stats: DataFrame, queries: dict[str, str], limit: int = 10) -> DataFrame:
    """(query, id, score, rank) of the best ``limit`` units of each named query, in one pass over the postings of all of their terms.

    Queries that are more than alternatives are scored one by one. What comes to the driver and is sent are four rows a term and query.
    """
    spark = postings.sparkSession
    parsed = {name: parse_query(q) for name, q in queries.items()}
    plain = {name: q for name, q in parsed.items() if q.clauses and _is_plain(q.tree)}
    out = postings.select(F.lit("").alias("query"), "id", F.lit(0.0).alias("score")).where("false")
    wanted = sorted({t for q in plain.values() for t in q.terms})
    if wanted:
        rows = postings.where(F.col("term").isin(wanted))
        of_field = {r["field"]: (r["n_units"], r["mean_length"] or 0.0) for r in stats.collect()}
        df = {(r["field"], r["term"]): r["df"] for r in rows.groupBy("field", "term").agg(F.count("*").alias("df")).collect()}
        idf = {key: math.log(1 + (of_field[key[0]][0] - n + 0.5) / (n + 0.5)) for key, n in df.items()}
        placed = []
        for name, q in plain.items():
            for i, c in enumerate(q.clauses):
                for f in FIELDS if c.field is None else [c.field]:
                    if all((f, t) in idf for t in c.terms):
                        weight = FIELDS[f][1] * sum(idf[(f, t)] for t in c.terms)
                        placed += [(name, i, n, t, len(c.terms), f, weight, float(of_field[f][1])) for n, t in enumerate(c.terms)]
        if placed:
            own = spark.createDataFrame(placed, "query string, clause int, at int, term string, n_terms int, field string, weight double, mean double")
            found = rows.join(F.broadcast(own), ["term", "field"])
            keys = ["query", "clause", "id", "field", "field_length", "weight", "mean"]
            hits = found.where("n_terms = 1").select(*keys, F.size("positions").alias("tf"))
            if any(len(c.terms) > 1 for q in plain.values() for c in q.clauses):
                begins = found.where("n_terms > 1").select(*keys, "n_terms", "at", F.explode("positions").alias("position"))
                whole = begins.groupBy(*keys, "n_terms", (F.col("position") - F.col("at")).alias("begin")).agg(F.countDistinct("at").alias("there")).where("there = n_terms")
                hits = hits.unionByName(whole.groupBy(*keys).agg(F.count("*").cast("int").alias("tf")))
            length = F.when(F.col("mean") > 0, F.col("field_length") / F.col("mean")).otherwise(0.0)
            part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
            out = hits.groupBy("query", "id").agg(F.sum(part).alias("score"))
    for name, q in parsed.items():
        if name not in plain:
            out = out.unionByName(scores(postings, stats, q).select(F.lit(name).alias("query"), "id", "score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*by_score()))).where(F.col("rank") <= limit)


# --- filters ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SearchFilter:
    """What results must be like. ``path`` is contained anywhere in a path; times are Unix seconds of indexing."""

    language: str | None = None
    path: str | None = None
    exclude_tests: bool = False
    modified_since: int | None = None

    def is_empty(self) -> bool:
        return self.language is None and self.path is None and not self.exclude_tests

    def column(self, path: Column | None = None, language: Column | None = None) -> Column:
        path = F.col("file_path") if path is None else path
        language = F.col("language") if language is None else language
        out = F.lit(True)
        if self.language is not None:
            out = out & (language == self.language)
        if self.path:
            out = out & path.contains(self.path)
        if self.exclude_tests:
            out = out & ~tx.is_test_file(path)
        return out


def filtered_search(units: DataFrame, postings: DataFrame, stats: DataFrame, query: str, limit: int = 10, only: SearchFilter | None = None, pushdown: bool = False) -> DataFrame:
    """Results (rank, id, score, name, ...) of units that pass a filter.

    As the index does it, a filter sees five times ``limit`` of the best rows, so it can leave
    fewer than ``limit``; with ``pushdown`` it is exact: the filter runs before the limit.
    """
    only = only or SearchFilter()
    found = scores(postings, stats, parse_query(query))
    shown = units.select("id", "name", "unit_type", "language", "file_path", "line_start", "line_end", F.nullif("full_signature", F.lit("")).alias("signature"), F.nullif("docstring", F.lit("")).alias("docstring"))
    if only.is_empty():
        best = found.orderBy(*by_score()).limit(limit)
        rows = best.join(shown, "id")
    elif pushdown:
        rows = found.join(shown.where(only.column()), "id").orderBy(*by_score()).limit(limit)
    else:
        best = found.orderBy(*by_score()).limit(limit * OVER_FETCH)
        rows = best.join(shown, "id").where(only.column()).orderBy(*by_score()).limit(limit)
    return ranked(rows).withColumn("snippet", tx.snippet(F.col("signature"), F.col("docstring"), F.col("name")))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds a rank from 1; only for results that a limit has made few."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*by_score())))


def modified_since(results: DataFrame, files: DataFrame, since: int) -> DataFrame:
    """Results whose file was indexed at ``since`` or later. It runs after the limit; files not tracked drop out."""
    fresh = files.where(F.col("last_indexed") >= since).select(F.col("file_path").alias("__path")).distinct()
    return results.join(fresh, F.col("file_path") == F.col("__path"), "left_semi")
