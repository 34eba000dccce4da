"""BM25 search over nodes or any other texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratograph.functions.paths import base_name
from stratograph.graph import Graph
from stratograph.session import cut

K1, B, PREFIX_WEIGHT, DEFAULT_LIMIT = 1.2, 0.75, 0.7, 15


def tokens(text: Column) -> Column:
    """ASCII words in lower case, each followed by its parts where it has several.

    Parts end at underscores, before a capital after a small letter, before the last capital of
    an acronym, and between letters and digits; a part equal to its word is not repeated. Only
    plain replacements are used, so the same expression exists in any SQL dialect.
    """
    def of(w: Column) -> Column:
        marked = F.regexp_replace(w, "([a-z])([A-Z])", "$1_$2")
        marked = F.regexp_replace(marked, "([A-Z])([A-Z][a-z])", "$1_$2")
        marked = F.regexp_replace(marked, "([A-Za-z])([0-9])", "$1_$2")
        marked = F.regexp_replace(marked, "([0-9])([A-Za-z])", "$1_$2")
        whole = F.array(F.lower(w))
        # most words of prose have no inner boundary and need none of this
        return F.when(w.rlike("[_A-Z0-9]"), F.concat(whole, F.split(F.lower(marked), "_"))).otherwise(whole)

    def told(a: Column) -> Column:
        """The word, and its parts if there are at least two."""
        several = F.size(F.filter(a, lambda x: x != "")) > 2
        return F.when(several, F.filter(a, lambda x, i: (i == 0) | ((x != "") & (x != F.get(a, F.lit(0)))))).otherwise(F.slice(a, 1, 1))

    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([a-zA-Z0-9_]+)"), F.lit(1))
    return F.flatten(F.transform(F.transform(found, of), told))


def node_texts(graph: Graph) -> DataFrame:
    """(id, text): name, signature, docstring and path of every node."""
    path = F.when(F.col("file_path") == "", F.col("path")).otherwise(F.col("file_path"))
    return graph.nodes.select("id", F.concat_ws(" ", "name", "signature", "docstring", path).alias("text"))


def index(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, documents): (term, id, tf) and (id, len); texts without words are in neither. Null texts have none."""
    words = texts.filter("id IS NOT NULL").select("id", tokens(F.col("text")).alias("w"))
    documents = words.select("id", F.size("w").cast("long").alias("len")).filter("len > 0")
    postings = words.select("id", F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return postings, documents


def scores(postings: DataFrame, documents: DataFrame, question: str, totals: DataFrame | None = None) -> DataFrame:
    """(id, score) of all documents with a word of the question; words asked twice count twice.

    A word that stands in no document falls back to all terms it begins, at 0.7 of their score. Only
    postings of the terms asked for leave the scan; the question is a handful of rows.
    """
    spark = postings.sparkSession
    asked = spark.range(1).select(F.explode(tokens(F.lit(question))).alias("q")).groupBy("q").agg(F.count("*").alias("times"))
    asked = F.broadcast(asked)  # the words of one question
    totals = documents.agg(F.count("*").alias("n"), F.avg("len").alias("mean")) if totals is None else totals  # one row
    exact = postings.join(asked, postings["term"] == asked["q"]).select("term", "id", "tf", "q", "times", F.lit(1.0).alias("weight"))
    known = postings.join(asked, postings["term"] == asked["q"], "left_semi").select("term").distinct()
    missing = F.broadcast(asked.join(known, asked["q"] == known["term"], "left_anti"))  # words of the question
    begun = postings.join(missing, F.startswith(postings["term"], missing["q"])).select("term", "id", "tf", "q", "times", F.lit(PREFIX_WEIGHT).alias("weight"))
    hits = exact.unionByName(begun)
    df = hits.select("term", "id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(df, "term").join(documents, "id").join(F.broadcast(totals))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    norm = F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("len") / F.col("mean")))
    return rows.groupBy("id").agg(F.sum(idf * norm * F.col("weight") * F.col("times")).alias("score"))


def question_words(question: str) -> list[str]:
    """The words of a question as :func:`tokens` gives them, each once."""
    out: dict[str, None] = {}
    for w in re.findall(r"[a-zA-Z0-9_]+", question):
        out[w.lower()] = None
        marked = w
        for pattern in (r"([a-z])([A-Z])", r"([A-Z])([A-Z][a-z])", r"([A-Za-z])([0-9])", r"([0-9])([A-Za-z])"):
            marked = re.sub(pattern, r"\1_\2", marked)
        parts = [p.lower() for p in marked.split("_") if p]
        out.update(dict.fromkeys(parts if len(parts) > 1 else []))
    return list(out)


def score_texts(texts: DataFrame, question: str) -> DataFrame:
    """:func:`scores` without an index: one pass over (id, text) in which only words that matter leave their row."""
    asked = question_words(question)
    rows = texts.filter("id IS NOT NULL").select("id", tokens(F.col("text")).alias("w"))
    totals = rows.select(F.size("w").alias("len")).filter("len > 0").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    wanted = F.filter("w", lambda t: reduce(lambda a, b: a | b, [F.startswith(t, F.lit(q)) for q in asked], F.lit(False)))
    # what is left is small next to the texts and read several times below
    hits = cut(rows.select("id", F.size("w").cast("long").alias("len"), wanted.alias("hits")).filter("size(hits) > 0"))
    postings = hits.select("id", F.explode("hits").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return scores(postings, hits.select("id", "len"), question, totals)


def store_index(graph: Graph, at: str) -> None:
    """Write the postings (term, id, tf, len) of all nodes in order of their terms, and the totals, below a folder.

    Every file holds a range of terms and says which, so a question opens only files its words can be in.
    """
    words = cut(node_texts(graph).filter("id IS NOT NULL").select("id", tokens(F.col("text")).alias("w")).filter("size(w) > 0"))
    words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean")).coalesce(1).write.parquet(f"{at}/totals")
    postings = words.select("id", F.size("w").cast("long").alias("len"), F.explode("w").alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
    postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{at}/postings")


def score_stored(spark, at: str, question: str) -> DataFrame:
    """:func:`scores` over a stored index: one scan that asks the files for the words of the question and what they begin."""
    asked = question_words(question)
    if not asked:
        return spark.createDataFrame([], "id string, score double")
    postings = spark.read.schema("term string, id string, len long, tf long").parquet(f"{at}/postings")
    hits = cut(postings.filter(reduce(lambda a, b: a | b, [F.startswith("term", F.lit(q)) for q in asked])))  # few next to the index, and read several times
    totals = spark.read.schema("n long, mean double").parquet(f"{at}/totals")
    return scores(hits.select("term", "id", "tf"), hits.select("id", "len").distinct(), question, totals)


def search(graph: Graph, question: str, level: str = "", limit: int = DEFAULT_LIMIT, fuzzy: bool = False) -> DataFrame:
    """Best nodes for a question: the best ``2 * limit`` of all, of these the wanted level, of these ``limit``.

    Graphs with a stored index answer from it, others from their texts. ``fuzzy``: words that neither stand in a text nor begin
    a word of one are replaced by the terms one edit away.
    """
    limit = limit if limit > 0 else DEFAULT_LIMIT
    spark = graph.nodes.sparkSession
    score = (lambda q: score_stored(spark, graph.index, q)) if graph.index else (lambda q: score_texts(node_texts(graph), q))
    if fuzzy:
        question = _corrected(graph, question)
    best = score(question).filter("score > 0").orderBy(F.desc("score"), "id").limit(2 * limit)
    path = F.when(F.col("file_path") == "", F.col("path")).otherwise(F.col("file_path"))
    rows = graph.nodes.join(F.broadcast(best), "id")  # at most 2 * limit rows
    if level:
        rows = rows.filter(F.upper("level") == level.upper())
    doc = F.when(F.length("docstring") > 100, F.concat(F.substring("docstring", 1, 100), F.lit("..."))).otherwise(F.col("docstring"))
    name = F.when(F.col("name") == "", base_name(path)).otherwise(F.col("name"))
    return rows.orderBy(F.desc("score"), "id").limit(limit).select("id", "level", name.alias("name"), path.alias("file_path"), "signature", doc.alias("docstring"), "score")


def _corrected(graph: Graph, question: str) -> str:
    """The question with each word that no term begins with replaced by the nearest terms, if there are any."""
    postings = graph.nodes.sparkSession.read.parquet(f"{graph.index}/postings") if graph.index else index(node_texts(graph))[0]
    out = []
    for word in re.findall(r"[a-zA-Z0-9_]+", question):
        known = postings.filter(F.startswith("term", F.lit(word.lower()))).head(1)
        out += [word] if known else [r["term"] for r in fuzzy_terms(postings, word, 3).collect()] or [word]
    return " ".join(out)


def fuzzy_terms(postings: DataFrame, word: str, limit: int = 50) -> DataFrame:
    """(term, distance, df): terms of at least three letters at most one edit away, the most frequent first."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    near = df.filter((F.length("term") >= 3) & (F.abs(F.length("term") - F.lit(len(word))) <= 1)).withColumn("distance", F.levenshtein("term", F.lit(word.lower())))
    return near.filter("distance <= 1").orderBy("distance", F.desc("df"), "term").limit(limit).select("term", "distance", "df")


def without(postings: DataFrame, documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index without some documents."""
    return postings.join(ids.select("id"), "id", "left_anti").select("term", "id", "tf"), documents.join(ids.select("id"), "id", "left_anti")


def top_terms(postings: DataFrame, per_document: int, documents: DataFrame) -> DataFrame:
    """The most telling terms of each document by tf * idf; ties by term."""
    n = documents.agg(F.count("*").alias("n"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weighed = postings.join(df, "term").join(F.broadcast(n)).withColumn("weight", F.col("tf") * F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "term"))
    return weighed.withColumn("rank", rank).filter(F.col("rank") <= per_document).select("id", "rank", "term", "weight")
