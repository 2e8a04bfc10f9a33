"""Token counts as rollups that are maintained by deltas.

A change is a document with a sign: +1 inserts it, -1 deletes it; a revised
count is the old row deleted and the new one inserted. A batch of changes is
summed by source, language and tokenizer version, and that sum, a small table,
is committed under the batch's name. A batch that is committed already is left
alone, so it can be sent again after any failure. Totals are the sum of all
committed deltas; groups that come to nothing are gone.

The sums of a batch are written under a name that nobody else has, and then a
marker that names them takes its place in one step that the file system grants
to one writer only: a hard link in a local folder, elsewhere the move of a file
to a name that must be free, which HDFS does at once. (An object store that
doesn't refuse an existing name needs a single writer.) A batch is there fully
once its marker is, and not at all before; what a failed or later writer has
written is never read. ``compact`` sums what is committed into one table, so
that totals don't read every batch that ever was.

Defined cases: a null source or language is a group of its own; a null text
counts as an inserted document without tokens; texts of any length are counted
whole; deleting what was never inserted leaves negative totals, which are
shown. Repeated rows count as often as they occur. Columns other than those of
a count are ignored, whatever their names. An empty batch commits nothing but
its name; an empty table has no counts, and no batches have no totals.

File systems are reached through the driver's JVM, so this needs a classic
session.
"""

from __future__ import annotations

import base64
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbascope.llm.bpe import load_ranks
from verbascope.llm.common import fresh_dir, over_batches, table
from verbascope.llm.mixing import word_count

GROUP = ("source", "lang", "tokenizer")
MEASURES = ("docs", "tokens", "chars")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"

#: Versions of the tokenizers that the query counts by.
WORDS, BPE = "words-1", "byte_bpe_50k-1"


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, chars of every row: words between white space."""
    return docs.select(
        docs.doc_id.cast("long").alias("doc_id"), docs.source.cast("string").alias("source"), docs.lang.cast("string").alias("lang"), F.lit(WORDS).alias("tokenizer"),
        word_count(docs.text).alias("tokens"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
    )


def bpe_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The same by the ids of a byte-level vocabulary, a file of fixed size whose ranks are broadcast."""
    shipped = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def make():
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shipped.value, special_tokens={})

        def step(batch: pa.RecordBatch) -> dict:
            texts = [x or "" for x in batch["text"].to_pylist()]
            return {
                "doc_id": batch["doc_id"], "source": batch["source"], "lang": batch["lang"], "tokenizer": [BPE] * len(texts),
                "tokens": [len(encoding.encode_ordinary(x)) for x in texts], "chars": [len(x) for x in texts],
            }

        return step

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(source as string) source", "cast(lang as string) lang", "text")
    return over_batches(rows, "doc_id long, source string, lang string, tokenizer string, tokens long, chars long", make)


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """``counts`` as changes: +1 inserts the rows, -1 deletes them."""
    return counts.withColumn("sign", F.lit(sign))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes that put ``new`` in the place of ``old``."""
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """Committed deltas in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.jvm = spark, folder, spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def marker(self, batch: str) -> str:
        return f"{self.folder}/batch-{base64.urlsafe_b64encode(batch.encode()).decode().rstrip('=')}"

    def read(self, path: str) -> list[str]:
        """The lines of a marker; none if it isn't there."""
        if not self.fs.exists(self.path(path)):
            return []
        file = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8").split()
        finally:
            file.close()

    def claim(self, path: str, lines: list[str]) -> bool:
        """Puts a marker of ``lines`` in its place, unless one is there; whether it did."""
        own = self.path(f"{self.folder}/claim-{uuid.uuid4().hex}")
        file = self.fs.create(own, False)
        file.write("\n".join(lines).encode())
        file.close()
        try:
            return self.linked(own, self.path(path)) if self.fs.getScheme() == "file" else self.fs.rename(own, self.path(path))
        finally:
            self.fs.delete(own, False)

    def linked(self, own, place) -> bool:
        """A second name for a local file; a plain move would replace what is there."""
        own, place = (self.jvm.java.io.File(x.toUri().getPath()).toPath() for x in (own, place))
        try:
            self.jvm.java.nio.file.Files.createLink(place, own)
        except Py4JJavaError:
            if self.jvm.java.nio.file.Files.isReadable(place):
                return False
            raise
        return True

    def committed(self, batch: str) -> bool:
        return bool(self.read(self.marker(batch)))

    def put(self, sums: DataFrame) -> str:
        """Writes sums under a name of their own."""
        name = f"sums-{uuid.uuid4().hex}"
        sums.where(" OR ".join(f"{m} != 0" for m in MEASURES)).write.parquet(f"{self.folder}/{name}")
        return name

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.folder}/{name}"), True)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Sums and commits ``changes`` (the columns of a count, and sign) unless ``batch`` is there; whether it did."""
        if self.committed(batch):
            return False
        name = self.put(changes.groupBy(*GROUP).agg(
            F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"), F.sum(F.col("sign") * F.col("chars")).alias("chars")
        ))
        if self.claim(self.marker(batch), [name]):
            return True
        self.drop(name)
        return False

    def listed(self, prefix: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.globStatus(self.path(f"{self.folder}/{prefix}-*")) or [])

    def compacted(self) -> tuple[int, list[str], list[str]]:
        """Number, sums (one or none) and batch markers of the latest compaction."""
        for name in reversed(self.listed("compaction")):
            if lines := self.read(f"{self.folder}/{name}"):
                return int(name.split("-")[1]), lines[:1], lines[1:]
        return 0, [], []

    def deltas(self) -> tuple[DataFrame, int, list[str]]:
        """All committed sums, the number of the compaction among them, and the markers of all batches in them."""
        number, sums, within = self.compacted()
        markers = self.listed("batch")
        later = {x: lines[0] for x in markers if x not in set(within) and (lines := self.read(f"{self.folder}/{x}"))}
        paths = [f"{self.folder}/{x}" for x in [*sums, *later.values()]]
        found = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return found, number, [*within, *later]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, chars over all committed batches."""
        sums = self.deltas()[0].groupBy(*GROUP).agg(*[F.sum(m).alias(m) for m in MEASURES])
        return sums.where(" OR ".join(f"{m} != 0" for m in MEASURES))

    def compact(self) -> bool:
        """Sums what is committed into one table, which stands for its batches; whether it did.

        Batches committed meanwhile are read beside it. What the compaction
        before it replaced is deleted, so totals asked for since then hold.
        """
        found, number, within = self.deltas()
        replaced = [line for x in self.compacted()[2] for line in self.read(f"{self.folder}/{x}")] + self.read(f"{self.folder}/compaction-{number - 1:012d}")[:1]
        name = self.put(found.groupBy(*GROUP).agg(*[F.sum(m).alias(m) for m in MEASURES]))
        if not self.claim(f"{self.folder}/compaction-{number + 1:012d}", [name, *within]):
            self.drop(name)
            return False
        for old in replaced:
            self.drop(old)
        return True


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents: inserted with estimates, revised by exact counts, the revision sent twice."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = Rollup(spark, fresh_dir(spark, "token-rollup"))
    words = word_counts(docs)
    guess = words.withColumns({"tokenizer": F.lit(BPE), "tokens": F.ceil(F.col("chars") / 4)})
    rollup.commit("load", signed(words.unionByName(guess), 1))
    exact = revised(guess, bpe_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    for _ in range(2):
        rollup.commit("recount", exact)
    return rollup.totals()
