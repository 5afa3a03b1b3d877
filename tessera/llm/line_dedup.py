"""Line deduplication over levelled sorted runs of line hashes (DataFrame functions only).

A store holds *runs*: tables of (h1, h2, n_docs, keeper), bucketed and sorted by
line hash, in the shared folder.  A new batch of documents counts its own line
keys, *merge-anti-joins* them with the runs (same buckets, so nothing is
exchanged), and adds those that no run holds as a run of level 0; so each key is
in one run.  For keys that a run holds already, the batch's counts go to the
*log*.  When a level holds ``fanout`` runs, they and the log that they answer for
are merged into one run of the next level, so that an entry is written again only
O(log batches) times.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
in lower case.  Keys travel as two 64-bit hashes (128 bits together).

Defined results: a null or empty text is one empty line and stays; a row without
doc_id keeps its lines and never counts as a document; rows that share a doc_id
are one document for counting, and each loses its own lines; of several holders
the largest doc_id keeps the line, in all its rows; an empty table gives an empty
result; extra columns, whatever their names, are left as they are.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _store
from tessera.llm._rows import packed, row_hash, same_row

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN_SCHEMA = "h1 long, h2 long, n_docs long, keeper long"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def doc_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2, first) of the lines that are long enough, of rows with a doc_id; ``first`` marks a hash's first entry in its row.

    Each row sorts its own hashes, so that no row costs more than n log n.
    """
    def entry(key: Column, pos: Column) -> Column:
        hashes = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x51ED), key).alias("h2"), pos.alias("pos"))
        return F.when(F.length(key) >= min_chars, hashes)

    def flag(e: Column, i: Column) -> Column:
        before = F.get(F.col("own"), i - 1)
        first = (i == 0) | (e["h1"] != before["h1"]) | (e["h2"] != before["h2"])
        return F.struct(e["h1"].alias("h1"), e["h2"].alias("h2"), e["pos"].alias("pos"), first.alias("first"))

    keys = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(F.col("text")).alias("row"), F.transform(split_lines(F.col("text")), line_key).alias("keys"))
    sorted_ = keys.select("doc_id", "row", F.sort_array(F.filter(F.transform("keys", entry), lambda e: e.isNotNull())).alias("own"))
    return sorted_.select("doc_id", "row", F.explode(F.transform("own", flag)).alias("e")).select("doc_id", "row", "e.pos", "e.h1", "e.h2", "e.first")


class LineRuns:
    """Levelled store of sorted runs of line hashes under one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4, min_chars: int = 40) -> None:
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.path = path or _store.new_path(spark, "runs")
        #: Aggregates come out in as many partitions, so that a bucket is one file.
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.levels: dict[int, list[str]] = {}
        self.log: list[str] = []

    def _write(self, run: DataFrame) -> str:
        name = f"tessera_run_{uuid.uuid4().hex}"
        run.select("h1", "h2", "n_docs", "keeper").write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        _store.delete_path(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        """Delete all runs."""
        for name in [*(n for runs in self.levels.values() for n in runs), *self.log]:
            self._drop(name)
        self.levels, self.log = {}, []

    def _read(self, name: str) -> DataFrame:
        """A run without its buckets: Spark 4.1 takes a union of bucketed tables for partitioned by bucket, and it isn't."""
        return self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.path}/{name}")

    def merge(self, names: list[str]) -> DataFrame:
        """One entry for each hash: documents add up (batches hold disjoint documents), the largest keeper stays."""
        every = reduce(DataFrame.unionByName, map(self._read, names))
        return every.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def add(self, docs: DataFrame, lines: DataFrame | None = None) -> None:
        """Take in a batch of documents of which no earlier batch holds a doc_id; compact full levels."""
        lines = doc_lines(docs, self.min_chars) if lines is None else lines
        found = lines.where("first")
        # rows that share an id count once
        shared = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
        shared = _store.materialize(shared, "shared-ids")
        if shared.take(1):
            once = found.join(shared, "doc_id", "left_semi").dropDuplicates(["doc_id", *KEY])
            found = found.join(shared, "doc_id", "left_anti").unionByName(once)
        own = self._write(found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")))
        if self.levels:
            fresh = self._write(self.unseen(self.spark.table(own)))
            self.log.append(self._write(self._with(own, fresh, "left_anti")))
            self._drop(own)
            own = fresh
        self.levels.setdefault(0, []).append(own)
        self.compact()

    def _with(self, name: str, other: str, kind: str) -> DataFrame:
        """The entries of a run that another run holds (left_semi) or doesn't hold (left_anti): a merge without an exchange."""
        return self.spark.table(name).join(self.spark.table(other).select(*KEY).hint("merge"), KEY, kind)

    def compact(self) -> None:
        """Merge the runs of a full level into one of the next; the log's counts go into the run that holds their key."""
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            full = self.levels.pop(level)
            if self.log:
                log, merged = self._write(self.merge(self.log)), self._write(self.merge(full))
                known = self._write(self._with(log, merged, "left_semi"))
                new = self._write(self.merge([merged, known]))
                rest = self._write(self._with(log, merged, "left_anti"))
                full, self.log = [*full, *self.log, log, merged, known], [rest]
            else:
                new = self._write(self.merge(full))
            self.levels.setdefault(level + 1, []).append(new)
            for name in full:
                self._drop(name)
            level += 1

    def entries(self) -> DataFrame:
        """The merged view of all runs and the log."""
        runs = [*(n for level in sorted(self.levels) for n in self.levels[level]), *self.log]
        return self.merge(runs) if runs else self.spark.createDataFrame([], RUN_SCHEMA)

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Merge-anti-join: the rows (lines, or a batch's keys) whose hash is in none of the runs."""
        for level in sorted(self.levels):
            for name in self.levels[level]:
                lines = lines.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        return lines

    def dropped(self, lines: DataFrame, min_docs: int) -> DataFrame:
        """(doc_id, row, pos) of the lines to drop: in ``min_docs`` documents or more, and held by another document than the keeper."""
        common = _store.materialize(self.entries().where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "common")
        return lines.join(common, KEY).where("doc_id <> keeper").select("doc_id", "row", "pos")


def drop_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """(own, lines, kept): each row of docs as a struct, its lines, and those that are left without the dropped (doc_id, row, pos)."""
    by_row = dropped.groupBy(F.col("doc_id").alias("of_doc"), F.col("row").alias("of_row")).agg(F.collect_set("pos").alias("gone"))
    joined = packed(docs).join(by_row, same_row(), "left").withColumn("lines", split_lines(F.col("own")["text"]))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.transform(F.array_except(every, F.col("gone")), lambda i: F.get(F.col("lines"), i))
    return joined.select("own", "lines", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(left).alias("kept"))


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 5, fanout: int = 3) -> DataFrame:
    """(own, lines, kept): drops each line whose key at least ``min_docs`` documents hold, except in the largest doc_id holding it.

    The documents arrive in ``batches`` (by hash of doc_id), each of which meets
    the runs and adds its own; the store's counts then decide every line.
    """
    spark = docs.sparkSession
    batch = lambda: F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(batches)).cast("int")
    lines = doc_lines(docs, min_chars).withColumn("batch", batch())
    path = _store.new_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    store = LineRuns(spark, fanout=fanout, min_chars=min_chars)
    for k in range(batches):
        store.add(docs.select("doc_id").where(batch() == k), lines.where(F.col("batch") == k))
    dropped = store.dropped(lines, min_docs)
    store.close()
    return drop_lines(docs, dropped)


def line_dedup_query(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``dedup_lines``."""
    out = dedup_lines(docs.select("doc_id", "text"))
    before, after = F.size("lines"), F.size("kept")
    return out.select("own.doc_id", before.cast("long").alias("n_lines"), (before - after).cast("long").alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


def line_dedup_stage(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the text that is left and its length; a null text stays null, with its n_chars as it was.

    Rows without doc_id stay as they are; rows that share an id each lose their
    own lines; an empty table gives an empty table.
    """
    out = dedup_lines(docs)
    text = F.array_join("kept", "\n")
    had = F.col("own")["text"].isNotNull()
    new = {"text": F.when(had, text), "n_chars": F.when(had, F.length(text).cast("long")).otherwise(F.col("own")["n_chars"]) if "n_chars" in docs.columns else None}
    kinds = {f.name: f.dataType for f in docs.schema}
    return out.select(*((new[c] if c in new else F.col("own")[c]).cast(kinds[c]).alias(c) for c in docs.columns))
