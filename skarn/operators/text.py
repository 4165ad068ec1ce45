"""BM25 over an inverted index of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions.text import Analyzer, counted, exploded, tokens


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_score(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """The BM25 share of one term. A length of 0 counts as the average, or 100 where that is 0."""
    length = F.when(dl == 0, F.when(avgdl == 0, F.lit(100.0)).otherwise(F.floor(avgdl).cast("double"))).otherwise(dl.cast("double"))
    norm = F.when(avgdl > 0, length / avgdl).otherwise(F.lit(0.0))
    score = idf(n, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * norm))
    return F.when((n == 0) | (df == 0), F.lit(0.0)).otherwise(score)


def _count(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"))


class TextIndex:
    """Postings (term, doc_id, tf) and lengths (doc_id, doc_len) of the documents that have terms.

    Stored postings have the document's length too, and frequencies (term, df) lie beside them, so that a search joins its terms once.
    """

    def __init__(self, postings: DataFrame, lengths: DataFrame, analyzer: Analyzer | str = Analyzer.STANDARD, k1: float = 1.2, b: float = 0.75, occurrences: DataFrame | None = None, frequencies: DataFrame | None = None) -> None:
        self.postings, self.lengths, self.analyzer, self.k1, self.b = postings, lengths, Analyzer(analyzer), k1, b
        self.occurrences = occurrences  # what postings count, where they aren't stored: a search then counts its own terms only
        self.frequencies = frequencies  # of the parts of a stored index; they add up
        self._source: tuple[DataFrame, str, str] | None = None  # what build() was given: documents, id and text

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "content", analyzer: Analyzer | str = Analyzer.STANDARD, k1: float = 1.2, b: float = 0.75) -> TextIndex:
        pairs = exploded(docs, id_col, text_col, analyzer)
        lengths = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("doc_len"))
        index = cls(_count(pairs), lengths, analyzer, k1, b, pairs)
        index._source = (docs, id_col, text_col)
        return index

    def _rows(self, path: str) -> DataFrame:
        """Postings with lengths; lengths are written. Rows with ids of their own are counted one by one: only postings move, and once."""
        if self._source is not None and self.analyzer is Analyzer.STANDARD:
            docs, id_col, text_col = self._source
            if not docs.groupBy(id_col).count().filter("count > 1").limit(1).count():
                counted(docs, id_col, text_col, True).write.mode("overwrite").parquet(f"{path}/lengths")
                return counted(docs, id_col, text_col)
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        lengths = self.postings.sparkSession.read.schema("doc_id long, doc_len long").parquet(f"{path}/lengths")
        return self.postings.join(lengths, "doc_id").select("term", "doc_id", "tf", "doc_len")

    def write(self, path: str) -> None:
        """Postings are laid out by hashes of term and document and sorted by term, so that a search's terms prune row groups and pages, and a frequent term has many tasks."""
        rows = self._rows(path)
        rows.repartition("term", F.pmod(F.xxhash64("doc_id"), F.lit(64))).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        stored = self.postings.sparkSession.read.parquet(f"{path}/postings")
        stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/frequencies")

    @classmethod
    def read(cls, spark: SparkSession, path: str | list[str], analyzer: Analyzer | str = Analyzer.STANDARD, k1: float = 1.2, b: float = 0.75) -> TextIndex:
        """From one folder, or from several whose documents differ."""
        paths = [path] if isinstance(path, str) else list(path)
        kinds = {"postings": "term string, doc_id long, tf int, doc_len long", "lengths": "doc_id long, doc_len long", "frequencies": "term string, df long"}
        got = {n: spark.read.schema(s).parquet(*[f"{p}/{n}" for p in paths]) if paths else spark.createDataFrame([], s) for n, s in kinds.items()}
        return cls(got["postings"], got["lengths"], analyzer, k1, b, frequencies=got["frequencies"])

    def totals(self) -> DataFrame:
        """One row: n, total_doc_length, avgdl."""
        return self.lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_doc_length"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl"))

    def stats(self) -> DataFrame:
        """One row: vocab_size, doc_count, total_doc_length, avg_doc_len."""
        vocab = (self.postings if self.frequencies is None else self.frequencies).agg(F.countDistinct("term").alias("vocab_size"))
        return vocab.crossJoin(self.totals().select(F.col("n").alias("doc_count"), "total_doc_length", F.col("avgdl").alias("avg_doc_len")))

    def document_frequencies(self) -> DataFrame:
        if self.frequencies is not None:
            return self.frequencies.groupBy("term").agg(F.sum("df").alias("df"))
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def scores(self, queries: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """qid, doc_id, score for all documents with a term of a query (qid, query). A repeated term counts again.

        ids restricts the documents; n, df and the average length stay those of all.
        """
        wanted = queries.select("qid", F.explode(tokens(F.col("query"), self.analyzer)).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
        terms = wanted.select("term").distinct()
        if self.frequencies is not None:
            df = self.frequencies.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
            hits = self.postings.join(wanted.join(df, "term"), "term")
        else:
            mine = self.postings.join(terms, "term", "left_semi") if self.occurrences is None else _count(self.occurrences.join(terms, "term", "left_semi"))
            df = mine.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            hits = mine.join(wanted.join(df, "term"), "term").join(self.lengths, "doc_id")
        if ids is not None:
            hits = hits.join(ids.select("doc_id"), "doc_id", "left_semi")
        hits = hits.crossJoin(F.broadcast(self.totals()))  # one row
        share = F.col("times") * term_score(F.col("tf"), F.col("df"), F.col("doc_len"), F.col("n"), F.col("avgdl"), self.k1, self.b)
        return hits.withColumn("_s", share).groupBy("qid", "doc_id").agg(F.round(F.sum("_s"), 10).alias("score"))  # equal documents tie, in whatever order terms are added

    def search_batch(self, queries: DataFrame, k: int, ids: DataFrame | None = None) -> DataFrame:
        """qid, rank, doc_id, score: the k best documents of each query."""
        by = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
        ranked = self.scores(queries, ids).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        return ranked.select("qid", "rank", "doc_id", "score")

    def search(self, query: str, k: int, ids: DataFrame | None = None) -> DataFrame:
        """rank, doc_id, score of one query."""
        one = self.postings.sparkSession.createDataFrame([(0, query)], "qid int, query string")
        top = self.scores(one, ids).orderBy(F.desc("score"), "doc_id").limit(k)
        return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")
