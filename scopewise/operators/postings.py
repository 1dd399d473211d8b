"""A BM25 index that is built once, saved, changed by document and searched without reading a text.

Chunks of a scope are dealt over ranges by a hash of their id. For each (scope, term, range) there is one posting
block: the chunks that hold the term, how often, and their lengths, with the largest count and the smallest length,
which bound what the term can add to any score in the range. A search first bounds every range of a question by the
sum of its terms' bounds, scores the k best ranges, takes the k-th score from them, and then opens only the blocks of
ranges whose bound reaches it. A frequent term's blocks are thus opened where rarer terms make them matter.

Blocks and chunk lengths are Parquet tables in folders by a hash of the scope. A change by document rewrites the folders
of its scopes; a search reads those of its questions' scopes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopewise.functions.text import distinct_tokens, tokens
from scopewise.operators.retrieval import K1, B, checked, each_term, filled, term_runs, top
from scopewise.sources.staging import scratch, staged

#: Chunks of a range, on average; folders of an index.
RANGE_CHUNKS, FOLDERS = 1024, 16


def folder_of(scope: Column) -> Column:
    return F.pmod(F.xxhash64(scope.cast("string")), F.lit(FOLDERS)).cast("int")


def saturated(tf: Column, dl: Column, avgdl: Column) -> Column:
    """A term's part in a BM25 score, but for its idf; grows with tf and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


class PostingIndex:
    """An index in a folder: upsert() and clear() change it, search() asks it."""

    def __init__(self, spark: SparkSession, path: str, range_chunks: int = RANGE_CHUNKS):
        self.spark, self.path, self.range_chunks = spark, path, range_chunks

    def _where(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _read(self, name: str) -> DataFrame:
        # an index of which everything was taken out has no file that tells its columns
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/columns/{name}").schema).parquet(f"{self.path}/{name}")

    def exists(self) -> bool:
        files, where = self._where("chunks")
        return files.exists(where)

    def blocks(self) -> DataFrame:
        """(scope, term, range, n, most, shortest, postings, folder)."""
        return self._read("blocks")

    def chunks(self) -> DataFrame:
        """(scope, document, chunk_id, dl, ranges, range, folder): every chunk, those without a term too."""
        return self._read("chunks")

    def upsert(self, chunks: DataFrame) -> None:
        """Replace all chunks of the documents of chunks(scope, document, chunk_id, content) by those given.

        Rows without a scope or a chunk id are left out; a chunk id that another document of the scope had is the new one's.
        """
        # a chunk's tokens go in order and as one text: they take the least room so
        words = F.array_join(F.sort_array(tokens(F.col("content"))), " ")
        new = chunks.where("scope IS NOT NULL AND chunk_id IS NOT NULL").select("scope", "document", "chunk_id", words.alias("words"))
        with scratch(self.spark) as stage:
            self._change(stage, stage(new.dropDuplicates(["scope", "chunk_id"]), "words"))  # each text is read once

    def clear(self, documents: DataFrame) -> None:
        """Take out all chunks of documents(scope, document)."""
        if self.exists():
            none = self.chunks().select("scope", "document", "chunk_id", F.lit("").alias("words")).limit(0)
            with scratch(self.spark) as stage:
                self._change(stage, none, documents.select("scope", "document"))

    def _change(self, stage: Callable[[DataFrame, str], DataFrame], new: DataFrame, gone: DataFrame | None = None) -> None:
        """Write the folders of the documents that go, those of new(scope, document, chunk_id, words) too, with new beside what stays in them."""
        gone = (new if gone is None else gone).select("scope", "document").distinct().withColumn("folder", folder_of(F.col("scope")))
        written = [row.folder for row in gone.select("folder").distinct().collect()]  # FOLDERS at most
        split = F.when(F.col("words") != "", F.split("words", " ")).when(F.col("words") == "", F.array().cast("array<string>"))
        lengths = new.select("scope", "document", "chunk_id", F.coalesce(F.size(split), F.lit(0)).alias("dl"))
        new = new.select("scope", "chunk_id", "words")
        old = None
        if self.exists():
            held = self.chunks().where(F.col("folder").isin(written))
            known = held.groupBy("scope").agg(F.max("ranges").alias("known"))
            same = (F.col("c.scope") == F.col("g.scope")) & F.col("c.document").eqNullSafe(F.col("g.document"))
            stay = held.alias("c").join(gone.alias("g"), same, "left_anti").select("scope", "document", "chunk_id", "dl")
            stay = stage(stay.join(lengths.select("scope", "chunk_id"), ["scope", "chunk_id"], "left_anti"), "stay")
            out = held.join(stay.select("scope", "chunk_id"), ["scope", "chunk_id"], "left_anti")
            # postings as arrays of numbers, which take the least room
            old = self.blocks().where(F.col("folder").isin(written)).select("scope", "range", "term", *[F.col(f"postings.{c}").alias(c) for c in ("chunk_id", "tf", "dl")])
            old = old.unionByName(out.select("scope", "range", F.lit(None).cast("string").alias("term"), F.array("chunk_id").alias("chunk_id"), *[F.lit(None).cast("array<int>").alias(c) for c in ("tf", "dl")]))
            lengths = stay.unionByName(lengths)
        else:
            known = lengths.select("scope", F.lit(1).alias("known")).limit(0)
        sizes = lengths.groupBy("scope").agg(F.ceil(F.count("*") / self.range_chunks).cast("int").alias("needed"))
        sizes = sizes.join(known, "scope", "left").select("scope", F.coalesce("known", "needed").alias("ranges"))  # set by a scope's first chunks
        sizes = stage(sizes, "ranges")
        at = F.pmod(F.xxhash64("chunk_id"), F.col("ranges")).cast("int")
        placed = stage(lengths.join(checked(sizes), "scope").withColumns({"range": at, "folder": folder_of(F.col("scope"))}), "lengths")
        new = new.join(checked(sizes), "scope").select("scope", at.alias("range"), "chunk_id", "words")
        made = self._blocks(new, old).sortWithinPartitions("folder", "scope", "term")
        # what is overwritten may be read: folders change places when all is written
        for rows, name, own in ((made, "blocks", placed.where("dl > 0")), (placed, "chunks", placed)):
            rows.limit(0).write.mode("ignore").parquet(f"{self.path}/columns/{name}")
            left = {r.folder for r in own.select("folder").distinct().collect()}
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(f"{self.path}/{name}")
            # a folder of which nothing is left is not overwritten
            for folder in written:
                files, where = self._where(f"{name}/folder={folder}")
                if folder not in left and files.exists(where):
                    files.delete(where, True)
                    files.mkdirs(self._where(name)[1])

    def _blocks(self, new: DataFrame, old: DataFrame | None) -> DataFrame:
        """The blocks of new(scope, range, chunk_id, words) and of old(scope, range, term, chunk_id, tf, dl), whose rows without a term name chunks that go.

        All are shuffled once, by scope and range: a chunk's words as one text, a block's postings as arrays. What makes
        terms of them, leaves out what goes and gathers the blocks is done where they are.
        """
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        new = new.select("scope", "range", "words", F.array("chunk_id").alias("chunk_id"), none("string", "term"), none("array<int>", "tf"), none("array<int>", "dl"))
        rows = new if old is None else new.unionByName(old.select("scope", "range", none("string", "words"), "chunk_id", "term", "tf", "dl"))
        rows = rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "scope", "range")
        split = F.when(F.col("words") != "", F.split("words", " "))
        rows = term_runs(rows.withColumnsRenamed({"dl": "_dl", "tf": "_tf"}), split, "scope", "range", "words", "chunk_id", "term", "_tf", "_dl")
        posting = lambda chunk, term, tf, dl, stays: F.struct(chunk.alias("chunk_id"), term.alias("term"), tf.cast("int").alias("tf"), dl.alias("dl"), F.lit(stays).alias("stays"))
        fresh = F.transform("runs", lambda r: posting(F.get("chunk_id", F.lit(0)), r["term"], r["tf"], F.col("dl"), True))
        kept = F.transform("chunk_id", lambda c, i: posting(c, F.col("term"), F.get("_tf", i), F.get("_dl", i), False))
        rows = rows.select("scope", "range", F.explode_outer(F.when(F.col("words").isNotNull(), fresh).otherwise(kept)).alias("p")).where("p IS NOT NULL").select("scope", "range", "p.*")
        if old is not None:
            goes = F.max(F.col("term").isNull()).over(Window.partitionBy("scope", "range", "chunk_id"))
            rows = rows.withColumn("_goes", goes).where("term IS NOT NULL AND (stays OR NOT _goes)")
        entry = F.struct("chunk_id", "tf", "dl")
        made = rows.groupBy("scope", "range", "term").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("shortest"), F.sort_array(F.collect_list(entry)).alias("postings"))
        return made.select(folder_of(F.col("scope")).alias("folder"), "scope", "term", "range", "n", "most", "shortest", "postings")

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(question terms, chunks, blocks of those terms) of the folders that the questions' scopes are in."""
        folders = F.broadcast(queries.select(folder_of(F.col("scope")).alias("folder")).distinct())  # FOLDERS rows at most
        asked = checked(each_term(queries, distinct_tokens(F.col("text")), "query_id", "scope"))
        # blocks of other terms are left where they are: with their postings they are nearly the whole index
        blocks = self.blocks().join(folders, "folder", "left_semi").join(asked.select("scope", "term"), ["scope", "term"], "left_semi")
        return asked, self.chunks().join(folders, "folder", "left_semi"), blocks

    @staticmethod
    def _scored(ranges: DataFrame, asked: DataFrame, rated: DataFrame, blocks: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score) of all chunks in the ranges that share a term with the question."""
        needed = ranges.select("query_id", "scope", "range").join(asked, ["query_id", "scope"]).join(rated, ["scope", "term"])
        opened = needed.join(blocks.select("scope", "term", "range", "postings"), ["scope", "term", "range"])
        opened = opened.select("query_id", "idf", "avgdl", F.explode("postings").alias("p"))
        part = F.col("idf") * saturated(F.col("p.tf"), F.col("p.dl"), F.col("avgdl"))
        return opened.groupBy("query_id", F.col("p.chunk_id").alias("chunk_id")).agg(F.sum(part).alias("score"))

    def _opened(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(scores of each question's first ranges, first and further ranges that can hold one of the k best, idf by term)."""
        asked, held, blocks = self._asked(queries)
        stats = held.groupBy("scope").agg(F.count("*").alias("n_all"), F.avg("dl").alias("avgdl"))
        heads = blocks.select("scope", "term", "range", "n", "most", "shortest").join(asked.select("scope", "term"), ["scope", "term"], "left_semi")
        df = heads.groupBy("scope", "term").agg(F.sum("n").alias("df"))
        idf = F.log((F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        rated = staged(df.join(stats, "scope").select("scope", "term", idf.alias("idf"), "avgdl"), "idf")
        bound = F.col("idf") * saturated(F.col("most"), F.col("shortest"), F.col("avgdl"))
        bounds = heads.join(rated, ["scope", "term"]).select("scope", "term", "range", bound.alias("bound"))
        reach = asked.join(bounds, ["scope", "term"]).groupBy("query_id", "scope", "range").agg(F.sum("bound").alias("reach"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reach"), "range"))
        reach = staged(reach.withColumn("place", place), "reach")
        first = staged(self._scored(reach.where(F.col("place") <= k), asked, rated, blocks), "first")
        kth = top(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        # ranks are made of rounded scores: what is a rounding below the k-th may tie with it
        near = F.col("reach") * (1 + 1e-6) >= F.coalesce("kth", F.lit(0.0))
        ranges = reach.join(kth, "query_id", "left").where((F.col("place") <= k) | near).select("query_id", "scope", "range", "place")
        return first, ranges, rated

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, score, rank): the k best chunks of each of queries(query_id, scope, text) in its scope."""
        asked, held, blocks = self._asked(queries)
        first, ranges, rated = self._opened(queries, k)
        rest = self._scored(ranges.where(F.col("place") > k), asked, rated, blocks)
        return filled(first.unionByName(rest), queries, held, k)

    def opened_blocks(self, queries: DataFrame, k: int) -> int:
        """How many blocks a search opens."""
        asked, _, blocks = self._asked(queries)
        ranges = self._opened(queries, k)[1].join(asked, ["query_id", "scope"]).select("scope", "term", "range").distinct()
        return blocks.join(ranges, ["scope", "term", "range"], "left_semi").count()
