"""An inverted index that takes new, changed and removed documents as they come.

Each batch of changes is a segment: its postings, the documents that it changes (doc_id, alive, terms), and what it does to the document
frequencies: one more for each term of a new text, one less for each of the text that it replaces. A document's postings are those of its
latest segment; older ones are dead, like those of removed documents. Frequencies and the number of documents are sums over the segments'
deltas, so they are right without looking at the postings; norms depend on all frequencies, and are made when an index is asked for.
compact() writes the live postings as one segment. A batch that is tried again replaces its own segment, whose number it has, and what it
subtracts comes from earlier segments alone, so it gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators.index import Index, document_norms, term_frequencies

POSTINGS, DOCUMENTS, DELTAS = "postings", "documents", "deltas"


class SegmentedIndex:
    """Segments under a folder of the shared store. Changes are (doc_id, text, seq): a null text removes the document; of several changes
    of a document in one batch the one with the greatest seq counts (of equal ones any text over a removal, then the greater text)."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "long"):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schemas = {POSTINGS: f"doc_id {id_type}, term string, tf long", DOCUMENTS: f"doc_id {id_type}, alive boolean, terms array<string>", DELTAS: "term string, df long, documents long"}

    def _segments(self) -> list[int]:
        """Numbers of the segments that are whole: deltas are written last."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{DELTAS}")
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        names = [s.getPath().getName() for s in store.listStatus(root)]
        whole = [n for n in names if n.startswith("segment=") and store.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{DELTAS}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in whole)

    def _base(self) -> int:
        """The segment from which on others count; compaction moves it."""
        return max([s for s in self._segments() if s % 2], default=0)

    def _read(self, table: str, before: int | None = None) -> DataFrame:
        base = self._base()
        found = [s for s in self._segments() if s >= base and (before is None or s < before)]
        if not found:
            return self.spark.createDataFrame([], self.schemas[table] + ", segment long")
        return self.spark.read.schema(self.schemas[table] + ", segment long").option("basePath", f"{self.folder}/{table}").parquet(*[f"{self.folder}/{table}/segment={s}" for s in found])

    def _write(self, table: str, segment: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/segment={segment}")

    def _latest(self, before: int | None = None) -> DataFrame:
        """(doc_id, segment, alive, terms) of every document, by its latest segment."""
        return self._read(DOCUMENTS, before).groupBy("doc_id").agg(F.max_by(F.struct("segment", "alive", "terms"), "segment").alias("x")).select("doc_id", "x.*")

    def apply(self, changes: DataFrame, number: int) -> None:
        """Writes batch `number` as a segment. Segments of batches have even numbers, those of compactions the odd ones after them."""
        segment = 2 * number + 2
        last = changes.groupBy("doc_id").agg(F.max_by("text", F.struct("seq", F.col("text").isNotNull(), F.coalesce("text", F.lit("")))).alias("text"))
        postings = term_frequencies(last.where("text IS NOT NULL"))
        self._write(POSTINGS, segment, postings.select("doc_id", "term", F.col("tf").cast("long").alias("tf")))
        own = self.spark.read.schema(self.schemas[POSTINGS]).parquet(f"{self.folder}/{POSTINGS}/segment={segment}").groupBy("doc_id").agg(F.collect_list("term").alias("terms"))
        empty = F.array().cast("array<string>")
        self._write(DOCUMENTS, segment, last.join(own, "doc_id", "left").select("doc_id", F.col("text").isNotNull().alias("alive"), F.coalesce("terms", empty).alias("terms")))
        now = self.spark.read.schema(self.schemas[DOCUMENTS]).parquet(f"{self.folder}/{DOCUMENTS}/segment={segment}")
        before = self._latest(segment).where("alive").join(now.select("doc_id"), "doc_id", "left_semi")
        both = now.where("alive").select("terms", F.lit(1).alias("d")).unionByName(before.select("terms", F.lit(-1).alias("d")))
        # every document counts once, under no term, and each of its terms once
        marks = both.select("d", F.explode(F.concat(F.array(F.lit(None).cast("string")), "terms")).alias("term"))
        summed = marks.groupBy("term").agg(F.sum("d").alias("n")).where("n <> 0")
        self._write(DELTAS, segment, summed.select("term", F.when(F.col("term").isNotNull(), F.col("n")).otherwise(0).alias("df"), F.when(F.col("term").isNull(), F.col("n")).otherwise(0).alias("documents")))

    def compact(self) -> None:
        """One segment of what is alive, in the place of all that there are. The others stay until drop_dead(), for readers that began before."""
        found = self._segments()
        if not found or found[-1] % 2:
            return
        segment = found[-1] + 1
        live, frequencies, n = self._latest().where("alive"), self._live(), self.documents()
        terms = self.terms()
        self._write(POSTINGS, segment, frequencies.select("doc_id", "term", "tf"))
        self._write(DOCUMENTS, segment, live.select("doc_id", "alive", "terms"))
        counts = terms.select("term", "df", F.lit(0).cast("long").alias("documents")).unionByName(self.spark.createDataFrame([(None, 0, n)], self.schemas[DELTAS]))
        self._write(DELTAS, segment, counts)

    def drop_dead(self) -> None:
        """Deletes the segments before the last compaction."""
        jvm, base = self.spark.sparkContext._jvm, self._base()
        dead = [s for s in self._segments() if s < base]
        for table in (POSTINGS, DOCUMENTS, DELTAS):
            for segment in dead:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/segment={segment}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _live(self) -> DataFrame:
        """(doc_id, term, tf) of the documents as they are now."""
        return self._read(POSTINGS).join(self._latest().where("alive").select("doc_id", "segment"), ["doc_id", "segment"]).drop("segment")

    def documents(self) -> int:
        return self._read(DELTAS).agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]

    def terms(self) -> DataFrame:
        """(term, df, idf) from the deltas alone."""
        known = self._read(DELTAS).where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return known.withColumn("idf", F.log1p(F.lit(max(self.documents(), 1)) / (1 + F.col("df"))))

    def index(self) -> Index:
        """The index of the documents as they are now."""
        live, terms = self._live(), self.terms()
        return Index(live, terms, document_norms(live, terms), self.documents())


def follow(changes: DataFrame, index: SegmentedIndex, checkpoint: str) -> StreamingQuery:
    """Applies a stream of changes, a segment for each batch."""
    return changes.writeStream.foreachBatch(lambda batch, number: index.apply(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
