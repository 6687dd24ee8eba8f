"""Reading level of each document from vocabulary coverage and sentence complexity.

1. Prose of every English document is split into words and sentences in numpy; fenced and
   indented code, stack traces, headings and inline code are left out.
2. Word counts over all documents give each word a rank: the number of words at least as
   frequent, so that equally frequent words share a rank and no order among them is needed.
3. The coverage rank of a document is the smallest rank whose vocabulary covers a fixed
   share of its words. The words of the first ``HEAD_WORDS`` ranks are sent to the documents,
   which settles nearly all of them; the others look up their rarer words by a shuffle, in
   which no word is hot, as all frequent ones are among those sent.
4. The grade is a linear function of the log of the coverage rank, the mean log sentence
   length and the mean word length over sentences. Its four coefficients are fitted to the
   labelled documents by least squares: SQL sums the normal equations, the driver solves
   the 4 x 4 system.

Only English documents with a text that is neither null nor blank and no code file are taken;
those whose prose is empty have a null grade, as has every document when there are fewer
than eight ratings. Raters' grades are averaged; null grades do not count. Repeated rows of
a document count once each in the corpus; of their coverage ranks the smallest holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import LETTER, SPACE, classes, word_keys
from lodestone.session import cut, drop, ship

SHARE = 0.5
PART_CHARS = 1 << 20
HEAD_WORDS = 1 << 16
RIDGE = 1e-6

FEATURES = "doc_id bigint, n_words bigint, n_sentences bigint, log_sentence double, word_length double, words array<bigint>, counts array<int>"


def english_prose(docs: DataFrame) -> DataFrame:
    """Documents in English with a text of their own that is not a code file."""
    return docs.where(F.lower("lang").startswith("en") & (F.coalesce("doc_kind", F.lit("")) != "codefile") & (F.trim(F.regexp_replace("text", r"\s+", " ")) != "") & F.col("doc_id").isNotNull())


def _spells(points: np.ndarray, at: np.ndarray, word: str) -> np.ndarray:
    """Whether ``word`` stands at each place; ``points`` ends with enough padding."""
    hit = np.ones(len(at), bool)
    for i, c in enumerate(word):
        hit &= points[at + i] == ord(c)
    return hit


def prose_mask(points: np.ndarray, line_begin: np.ndarray, doc_of_line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line whether it is prose, per character whether it lies in inline code. ``points`` is padded behind n."""
    blank = (points[:n] == 32) | (points[:n] == 9)
    solid = np.append(np.flatnonzero(~blank), n)
    head = solid[np.searchsorted(solid, line_begin)]
    fence = _spells(points, head, "```") | _spells(points, head, "~~~")
    before = np.cumsum(fence) - fence
    doc_first = np.flatnonzero(np.append(True, doc_of_line[1:] != doc_of_line[:-1]))
    inside = (before - np.repeat(before[doc_first], np.diff(np.append(doc_first, len(line_begin))))) % 2 == 1
    code = fence | inside | (head - line_begin >= 4) | (points[line_begin] == 9) | (points[head] == ord("#"))
    for start in ("Traceback", 'File "', "at "):
        code |= _spells(points, head, start)
    part = classes()[points[:n]]
    wordy = (part == LETTER) | (part == 2) | (points[:n] == ord("_")) | (points[:n] == ord("."))
    after = np.append(np.flatnonzero(~wordy), n)
    end = after[np.searchsorted(after, head)]
    for name in ("Error:", "Exception:"):
        size = len(name) - 1
        code |= (end - head >= size) & _spells(points, np.maximum(end - size, 0), name)
    ticks = np.cumsum(points[:n] == ord("`"))
    at_line = ticks[line_begin] - (points[line_begin] == ord("`"))
    line_end = np.append(line_begin[1:], n)
    odd_line = (ticks[np.maximum(line_end - 1, 0)] - at_line) % 2 == 1  # an unpaired mark hides nothing
    spans = line_end - line_begin
    inline = ((ticks - np.repeat(at_line, spans)) % 2 == 1) & ~np.repeat(odd_line, spans)
    return ~code, inline


def text_features(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Per text: words, sentences, mean log sentence length, mean word length; then distinct words and counts as flat arrays with offsets."""
    whole = "".join(t + "\n" for t in texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass") + b"\0" * 64, np.uint32)
    n = len(points) - 16
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc_begin = np.cumsum(sizes) - sizes
    newline = np.flatnonzero(points[:n] == 10)
    line_begin = np.unique(np.concatenate([doc_begin, newline[newline + 1 < n] + 1]))
    doc_of_line = np.searchsorted(doc_begin, line_begin, side="right") - 1
    is_prose, inline = prose_mask(points, line_begin, doc_of_line, n)
    spans = np.diff(np.append(line_begin, n))
    kind = classes()[points[:n]]
    letter = (kind == LETTER) & np.repeat(is_prose, spans) & ~inline
    mark = np.flatnonzero(points[1 : n - 1] == 0x27) + 1
    letter[mark[letter[mark - 1] & letter[mark + 1]]] = True
    edge = np.diff(np.concatenate([[0], letter.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lower = points[:n].copy()
    lower[(lower >= 65) & (lower <= 90)] += 32
    key = word_keys(lower, begin, end)
    doc = np.searchsorted(doc_begin, begin, side="right") - 1
    # sentences end at a mark before white space, at blank lines, at lines left out and with the document
    stop = np.zeros(n, bool)
    dot = np.flatnonzero((points[:n] == ord(".")) | (points[:n] == ord("!")) | (points[:n] == ord("?")))
    stop[dot[kind[np.minimum(dot + 1, n - 1)] == SPACE]] = True
    empty = (points[line_begin] == 10) | (points[line_begin] == 13)
    stop[line_begin[empty | ~is_prose]] = True
    stop[doc_begin] = True
    sentence = np.cumsum(stop)[begin] if len(begin) else begin
    length = (end - begin).astype(np.float64)
    if len(begin):
        fresh = np.flatnonzero(np.append(True, (sentence[1:] != sentence[:-1]) | (doc[1:] != doc[:-1])))
        words_in = np.diff(np.append(fresh, len(begin)))
        mean_length = np.add.reduceat(length, fresh) / words_in
        kept = words_in > 2
        of = doc[fresh][kept]
        n_sentences = np.bincount(of, minlength=len(texts))
        with np.errstate(invalid="ignore", divide="ignore"):
            log_sentence = np.bincount(of, np.log(words_in[kept]), len(texts)) / n_sentences
            word_length = np.bincount(of, mean_length[kept], len(texts)) / n_sentences
    else:
        n_sentences = np.zeros(len(texts), np.int64)
        log_sentence = word_length = np.full(len(texts), np.nan)
    flat = np.empty(0, np.int64)
    counts = np.empty(0, np.int32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    if len(begin):
        order = np.lexsort((key, doc))
        word, of = key[order], doc[order]
        first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (of[1:] != of[:-1])))
        counts = np.diff(np.append(first, len(word))).astype(np.int32)
        flat = word[first].view(np.int64)
        bounds = np.searchsorted(of[first], np.arange(len(texts) + 1))
    return np.bincount(doc, minlength=len(texts)), n_sentences, log_sentence, word_length, flat, counts, bounds


def features(docs: DataFrame) -> DataFrame:
    """Words, sentences and distinct words of each document; see FEATURES. No shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            begin = size = 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= PART_CHARS or i == len(texts) - 1:
                    words, sentences, logs, lengths, flat, counts, bounds = text_features(texts[begin : i + 1])
                    offsets = pa.array(bounds.astype(np.int32))
                    nan = np.isnan(logs)
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(begin, i + 1 - begin), pa.array(words.astype(np.int64)), pa.array(sentences.astype(np.int64)), pa.array(logs, mask=nan), pa.array(lengths, mask=nan), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(counts))],
                        names=["doc_id", "n_words", "n_sentences", "log_sentence", "word_length", "words", "counts"],
                    )
                    begin, size = i + 1, 0

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, FEATURES)


def word_ranks(parts: DataFrame) -> DataFrame:
    """(word, rank): the number of words of the corpus that are at least as frequent.

    Ranks come from a histogram of counts, so no task sorts the vocabulary.
    """
    pairs = parts.select(F.explode(F.arrays_zip("words", "counts")).alias("p"))
    totals = pairs.groupBy(F.col("p.words").alias("word")).agg(F.sum("p.counts").alias("total"))
    totals = cut(totals)
    histogram = totals.groupBy("total").agg(F.count("*").alias("n"))
    bucket = F.floor(F.log2("total") * 8)  # few buckets: their running sum is tiny, the rest runs within buckets
    with_bucket = histogram.withColumn("bucket", bucket)
    above = with_bucket.groupBy("bucket").agg(F.sum("n").alias("in_bucket")).withColumn("above", F.sum("in_bucket").over(Window.orderBy(F.desc("bucket"))) - F.col("in_bucket"))
    ranked = with_bucket.join(above, "bucket").withColumn("rank", F.col("above") + F.sum("n").over(Window.partitionBy("bucket").orderBy(F.desc("total"))))
    return totals.join(ranked.select("total", "rank"), "total").select("word", "rank")


def covered(words: np.ndarray, counts: np.ndarray, bounds: np.ndarray, need: np.ndarray, head: np.ndarray, head_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coverage rank of each document by the words of ``head`` (sorted), -1 where they don't suffice; how many words they cover; which words are others."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    place = np.minimum(np.searchsorted(head, words), len(head) - 1) if len(head) else np.zeros(len(words), np.int64)
    known = head[place] == words if len(head) else np.zeros(len(words), bool)
    of, rank, count = owner[known], head_rank[place[known]] if len(head) else np.zeros(0, np.int64), counts[known]
    order = np.lexsort((rank, of))
    of, rank, total = of[order], rank[order], np.concatenate([[0], np.cumsum(count[order])])
    start = np.searchsorted(of, np.arange(n + 1))
    so_far = total[1:] - total[start[of]]
    enough = np.flatnonzero(so_far >= need[of])
    out = np.full(n, -1, np.int64)
    first = np.append(True, of[enough][1:] != of[enough][:-1]) if len(enough) else np.zeros(0, bool)
    out[of[enough[first]]] = rank[enough[first]]
    return out, total[start[1:]] - total[start[:-1]], ~known


def coverage_ranks(parts: DataFrame, ranks: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, coverage_rank): smallest rank whose words make up ``share`` of the document's words.

    A rank is the number of words at least as frequent, so at most HEAD_WORDS words, of 16 bytes each, come to the driver and are sent on.
    """
    spark = parts.sparkSession
    top = ranks.where(F.col("rank") <= HEAD_WORDS).toArrow().sort_by("word")
    sent = spark.sparkContext.broadcast((top.column("word").to_numpy(), top.column("rank").to_numpy().astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
            bounds = offsets - offsets[0]
            rank, have, others = covered(words, counts, bounds, batch.column(1).to_numpy() * share, *sent.value)
            others &= np.repeat(rank < 0, np.diff(bounds))
            ends = pa.array(np.concatenate([[0], np.cumsum(others)])[bounds].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[others])) for x in (words, counts.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(have), pa.array(rank, mask=rank < 0), *lists], names=["doc_id", "n_words", "have", "coverage_rank", "words", "counts"])

    settled = cut(parts.select("doc_id", "n_words", "words", "counts").mapInArrow(run, "doc_id bigint, n_words bigint, have bigint, coverage_rank bigint, words array<bigint>, counts array<int>"))
    pairs = settled.where("coverage_rank IS NULL").select("doc_id", "n_words", "have", F.explode(F.arrays_zip("words", "counts")).alias("p")).select("doc_id", "n_words", "have", F.col("p.words").alias("word"), F.col("p.counts").alias("n"))
    by_doc = pairs.hint("merge").join(ranks, "word").groupBy("doc_id", "n_words", "have").agg(F.array_sort(F.collect_list(F.struct("rank", "n"))).alias("all"))
    zero = F.struct(F.col("have").alias("sum"), F.lit(None).cast("bigint").alias("rank"))
    need = F.col("n_words") * F.lit(float(share))
    step = lambda acc, x: F.when(acc["rank"].isNotNull(), acc).otherwise(F.struct((acc["sum"] + x["n"]).alias("sum"), F.when(acc["sum"] + x["n"] >= need, x["rank"]).alias("rank")))
    late = by_doc.select("doc_id", F.aggregate("all", zero, step)["rank"].alias("coverage_rank"))
    return settled.where("coverage_rank IS NOT NULL").select("doc_id", "coverage_rank").unionByName(late).groupBy("doc_id").agg(F.min("coverage_rank").alias("coverage_rank"))


def fit(rows: DataFrame) -> list[float] | None:
    """Least-squares coefficients of (1, x1, x2, x3) against ``grade`` with weights, from sums made in SQL."""
    names = ["one", "x1", "x2", "x3", "grade"]
    rows = rows.withColumn("one", F.lit(1.0))
    sums = [F.sum(F.col("weight") * F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    row = rows.agg(*sums).first()
    if row["one_one"] is None or row["one_one"] < 8:
        return None
    get = lambda a, b: row[f"{a}_{b}"] if names.index(a) <= names.index(b) else row[f"{b}_{a}"]
    x = names[:-1]
    left = np.array([[get(a, b) for b in x] for a in x]) + np.eye(4) * RIDGE
    return np.linalg.solve(left, np.array([get(a, "grade") for a in x])).tolist()


def reading_levels(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, coverage_rank, log_sentence, word_length, grade) of English prose documents."""
    parts = cut(features(english_prose(docs)))
    cover = coverage_ranks(parts, cut(word_ranks(parts)), share)
    measured = cut(parts.drop("words", "counts").join(cover, "doc_id", "left"))
    x = measured.withColumns({"x1": F.log1p("coverage_rank"), "x2": F.col("log_sentence"), "x3": F.col("word_length")})
    rated = labels.where("grade IS NOT NULL").groupBy("doc_id").agg(F.avg("grade").alias("grade"), F.count("*").cast("double").alias("weight"))
    usable = x.dropna(subset=["x1", "x2", "x3"])
    k = fit(usable.join(rated, "doc_id"))
    grade = F.lit(None).cast("double") if k is None else F.lit(k[0]) + F.lit(k[1]) * F.col("x1") + F.lit(k[2]) * F.col("x2") + F.lit(k[3]) * F.col("x3")
    return x.withColumn("grade", grade).select("doc_id", "n_words", "coverage_rank", "log_sentence", "word_length", "grade")
