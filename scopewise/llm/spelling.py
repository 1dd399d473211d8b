"""Spelling variants: words that differ by one letter from a much more frequent word.

The vocabulary is sorted and cut into shards of a bounded number of letters, each a compact trie: nodes in level order,
so that a node's children are neighbours and their labels one piece of a string. The tries go out by broadcast, a
bounded number at a time, each number once past all words: a word's distance-one Levenshtein automaton walks every
trie depth-first. Its states are a position in the word and whether the one error is spent; a branch ends where no
child carries the letter that the automaton needs. What accepts is a neighbour. A task gives a word's count and best
neighbour only, and those of all shards are reduced.

Words are counted in Python workers, each batch's before they are shuffled. Forms are followed to their roots by
doubling: a form is FACTOR times as frequent, so that a chain is short.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopewise.llm.common import stage

#: A maximal run of A-Z, a-z and U+00C0 to U+00FF in UTF-8 whose A-Z are lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LEAST_LETTERS, LEAST_COUNT, FACTOR = 6, 5, 5
#: One run in so many, by its checksum, lacks a letter.
TYPO = 199
#: Letters of a shard, but for a single longer word; shards of a broadcast. A node takes 13 to 16 bytes: 40 MB in all.
SHARD_LETTERS, SHARDS = 400_000, 7
#: Different words that a worker counts before it hands them on, and words that a task looks up.
COUNTED, LOOKED_UP = 200_000, 20_000


def runs_of(doc_id: str, text: str | None) -> Counter:
    """How often each word is in the text, with the letter lost where the run's checksum says so."""
    out: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall((text or "").encode().lower())).items():
        h = zlib.crc32(run, start)
        if h % TYPO == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        out[run] += n
    return out


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()

    def handed_on() -> pd.DataFrame:
        rows = [(w, n) for w, n in ((run.decode(), n) for run, n in counts.items()) if len(w) >= LEAST_LETTERS]
        counts.clear()
        return pd.DataFrame(rows, columns=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.id, batch.text, strict=True):
            counts.update(runs_of(doc_id, text))
            if len(counts) > COUNTED:
                yield handed_on()
    yield handed_on()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least LEAST_LETTERS letters and LEAST_COUNT occurrences."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Trie:
    """Sorted distinct words: labels[i] leads to node i, whose children are first[i] to first[i + 1] - 1; counts[i] is the n of the word that ends there, else 0."""

    def __init__(self, labels: str, first: bytes, counts: bytes):
        self.labels, self.first, self.counts = labels, array("I", first), array("q", counts)

    @classmethod
    def of(cls, words: list[str], ns: list[int]) -> Trie:
        labels, first, counts = ["\0"], array("I"), array("q")
        level = [(0, len(words))]
        depth = 0
        while level:
            below = []
            for low, high in level:
                # the word that ends here comes first
                ends = low < high and len(words[low]) == depth
                counts.append(ns[low] if ends else 0)
                first.append(len(labels))
                at = low + ends
                while at < high:
                    letter, start = words[at][depth], at
                    while at < high and words[at][depth] == letter:
                        at += 1
                    labels.append(letter)
                    below.append((start, at))
            level, depth = below, depth + 1
        first.append(len(labels))
        return cls("".join(labels), first.tobytes(), counts.tobytes())

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words at exactly one inserted, deleted or replaced letter, each once, with their counts."""
        labels, first, counts = self.labels, self.first, self.counts
        find, long = labels.find, len(word)

        def accepts(node: int, at: int) -> int:
            """The count of the word that the rest of the letters leads to, the error being spent."""
            while at < long:
                node = find(word[at], first[node], first[node + 1])
                if node < 0:
                    return 0
                at += 1
            return counts[node]

        node, before = 0, ""
        for at in range(long + 1):
            letter = word[at : at + 1]
            if letter and letter != before and (n := accepts(node, at + 1)):
                yield word[:at] + word[at + 1 :], n
            for child in range(first[node], first[node + 1]):
                other = labels[child]
                if letter and other != letter and (n := accepts(child, at + 1)):
                    yield word[:at] + other + word[at + 1 :], n
                # the same letter twice: inserting it after or before is one word
                if other != before and (n := accepts(child, at)):
                    yield word[:at] + other + word[at:], n
            node, before = (find(letter, first[node], first[node + 1]) if letter else -1), letter
            if node < 0:
                return


def _tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted words of a partition -> tries of SHARD_LETTERS letters at most, but for single longer words."""
    words: list[str] = []
    ns: list[int] = []
    letters = shard = 0

    def built() -> pd.DataFrame:
        trie = Trie.of(words, ns)
        return pd.DataFrame([(shard, letters, trie.labels, trie.first.tobytes(), trie.counts.tobytes())], columns=["shard", "letters", "labels", "first", "counts"])

    for batch in batches:
        for word, n in zip(batch.word, batch.n, strict=True):
            if words and letters + len(word) > SHARD_LETTERS:
                yield built()
                words, ns, letters, shard = [], [], 0, shard + 1
            words.append(word)
            ns.append(n)
            letters += len(word)
    if words:
        yield built()


def _looked_up(load: Callable[[], Iterable[tuple[str, bytes, bytes]]]):
    """Words -> their number of neighbours in the tries and the best one, for those that have any."""

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = [Trie(*t) for t in load()]
        for batch in batches:
            rows = []
            for word in batch.word:
                n_near, best = 0, None
                for trie in tries:
                    for other, n in trie.near(word):
                        n_near += 1
                        best = min(best, (-n, other)) if best else (-n, other)
                if best:
                    rows.append((word, n_near, best[0], best[1]))
            yield pd.DataFrame(rows, columns=["word", "n_near", "minus_n", "form"])

    return looked_up


def _loads(shards: list) -> list[list[int]]:
    """Rows (shard, letters) in order -> the shards of each broadcast: SHARD_LETTERS * SHARDS letters at most, but for a single longer one."""
    out, held = [], math.inf
    for shard, letters in shards:
        if held + letters > SHARD_LETTERS * SHARDS:
            out.append([])
            held = 0
        out[-1].append(shard)
        held += letters
    return out


def near_words(words: DataFrame) -> DataFrame:
    """words(word, n), staged -> (word, n_near, form_n, form) for words with a neighbour: how many, and the most frequent, ties to the first."""
    spark = words.sparkSession
    total, letters = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    parts = max(1, math.ceil(letters / (SHARD_LETTERS * SHARDS)))
    schema = "shard long, letters long, labels string, first binary, counts binary"
    sharded = words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInPandas(_tries, schema)
    tries = stage(sharded.withColumn("shard", F.spark_partition_id() * F.lit(2**32) + F.col("shard")), "tries")
    asked = words.select("word").repartition(max(spark.sparkContext.defaultParallelism, math.ceil(total / LOOKED_UP)))
    found = None
    for shards in _loads(tries.select("shard", "letters").sort("shard").collect()):  # two numbers for each shard
        sent = spark.sparkContext.broadcast([(r.labels, bytes(r.first), bytes(r.counts)) for r in tries.where(F.col("shard").isin(shards)).select("labels", "first", "counts").collect()])
        part = stage(asked.mapInPandas(_looked_up(lambda sent=sent: sent.value), "word string, n_near long, minus_n long, form string"), "near-words")
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return words.limit(0).select("word", F.lit(0).cast("long").alias("n_near"), F.lit(0).cast("long").alias("form_n"), F.lit("").alias("form"))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "form")).alias("_best"))
    return best.select("word", "n_near", (-F.col("_best.minus_n")).alias("form_n"), F.col("_best.form").alias("form"))


def roots_of(forms: DataFrame) -> DataFrame:
    """forms(word, form) without cycles -> (word, root): where following forms ends. Each round doubles what is followed."""
    roots = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = stage(roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        roots = joined.drop("_moved")
        if not joined.where("_moved").limit(1).count():
            return roots


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, n, form, root, n_near, form_n.

    Words are the letter runs of all texts, A-Z lower-cased, of LEAST_LETTERS letters and LEAST_COUNT occurrences at
    least; one run in TYPO, by a checksum of document and run, lacks a letter. n_near counts the words at one
    inserted, deleted or replaced letter; form is the one of the largest n (ties: the first by code point) if its n,
    form_n, is FACTOR times the word's at least, else null; root is where following forms from the word ends, the
    word itself if it has none.

    Null and empty texts have no words; a null id counts as an empty one. Repeated rows count each. An empty table
    gives an empty result; other columns are not read.
    """
    words = stage(vocabulary(docs, id_col, text_col), "vocabulary")
    near = words.join(near_words(words), "word", "left")
    has_form = F.col("form_n") >= FACTOR * F.col("n")
    near = stage(near.select("word", "n", F.when(has_form, F.col("form")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("form_n")).alias("form_n")), "near")
    return near.join(roots_of(near.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
