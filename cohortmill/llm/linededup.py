"""Line deduplication over levelled sorted runs of line hashes, with DataFrame functions alone."""

from __future__ import annotations

import uuid
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.llm.staging import fresh, new_folder, stage

#: The white space stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case and every other letter as it is."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def line_hash(line: Column, min_chars: int) -> Column:
    """Two independent 64-bit hashes of the key, NULL for a key that is too short to count."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")))


class LineRuns:
    """Runs of (h1, h2, n): hashes of line keys with the number of documents that hold them, kept by level.

    A batch adds one run to level 0, and two runs of a level are merged into one of the next, so a store of N batches has at most
    log2 N runs. A run is a table bucketed and sorted by hash, one row per key. Joining a batch with it moves the batch alone, and
    merging two runs is a full outer join bucket by bucket that moves nothing. Tables lie in the shared folder, and ``close`` removes them.

    With ``folder`` the store lasts: its runs lie there, next to a manifest that is written after every batch and names them, and a store
    opened with the same folder later, by any session, goes on where that batch ended. A batch cut short leaves files that no manifest names.
    """

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int | None = None, folder: str | None = None):
        self.spark, self.min_docs, self.folder = spark, min_docs, folder
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}
        self.folders: dict[str, str] = {}
        self.batches = 0
        if folder is not None and self._files("manifest-*"):
            self._open()

    def add(self, hashes: DataFrame) -> None:
        """Count the hashes of a batch (a row per document and key), leave out those that a run shows to be frequent, keep the rest as a run."""
        counts = hashes.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"))
        for run in self._runs():
            counts = counts.join(run.where(F.col("n") >= self.min_docs).select(*HASH), HASH, "left_anti")
        new, level, old_runs = self._write(counts), 0, []
        while level in self.levels:
            old = self.levels.pop(level)
            merged = self._write(self._merged(self.spark.table(old), self.spark.table(new)))
            old_runs += [old, new]
            new, level = merged, level + 1
        self.levels[level] = new
        self.batches += 1
        if self.folder is not None:
            self._save()
        self._drop(*old_runs)

    def frequent(self) -> DataFrame:
        """Hashes of the keys found in at least ``min_docs`` documents, over all batches."""
        out = None
        for run in self._runs():
            out = run if out is None else self._merged(out, run)
        return out.where(F.col("n") >= self.min_docs).select(*HASH)

    def close(self) -> None:
        """Forget the runs; their files stay if the store lasts."""
        if self.folder is None:
            self._drop(*self.levels.values())
        else:
            for name in self.levels.values():
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = {}

    def _runs(self) -> list[DataFrame]:
        """The runs, smallest first."""
        return [self.spark.table(self.levels[k]) for k in sorted(self.levels)]

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.withColumnRenamed("n", "n_a").join(b.withColumnRenamed("n", "n_b"), HASH, "full")
        return both.select(*HASH, (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"))

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.folders[name] = new_folder(self.spark, "run") if self.folder is None else f"{self.folder}/{name}"
        dealt = counts.repartition(self.buckets, *HASH)
        dealt.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self.folders[name]).format("parquet").saveAsTable(name)
        return name

    def _save(self) -> None:
        """A new manifest, then the end of the old one: at every moment one of them is whole."""
        rows = [(self.batches, level, name, self.buckets, self.min_docs) for level, name in self.levels.items()]
        path = f"{self.folder}/manifest-{self.batches:010d}"
        self.spark.createDataFrame(rows, "batches long, level int, run string, buckets int, min_docs int").coalesce(1).write.mode("overwrite").parquet(path)
        for old in self._files("manifest-*"):
            if not old.endswith(path.rsplit("/", 1)[1]):
                self._delete(old)

    def _open(self) -> None:
        whole = [f.rsplit("/", 1)[0] for f in self._files("manifest-*/_SUCCESS")]
        rows = self.spark.read.parquet(max(whole, key=lambda f: f.rsplit("/", 1)[1])).collect()
        if {r["min_docs"] for r in rows} != {self.min_docs}:
            raise ValueError(f"the store counts up to {rows[0]['min_docs']} documents, not {self.min_docs}")
        self.batches, self.buckets = rows[0]["batches"], rows[0]["buckets"]
        for r in rows:
            name = self.levels[r["level"]] = r["run"]
            self.folders[name] = f"{self.folder}/{name}"
            keys = ", ".join(HASH)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.folders[name]}'")

    def _files(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [x.getPath().toString() for x in found or []]

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._delete(self.folders.pop(name))


def hashed_lines(docs: DataFrame, id: str, text: str, min_chars: int, batches: int) -> DataFrame:
    """(k1, k2, known, hashes, batch) of each row, staged with a folder per batch: hashes of its id and text, whether it has an id, and
    hashes of its lines in order.

    Rows are dealt into batches by a hash of their id, rows without one by their text. A line whose key is too short has a NULL in its place.
    """
    hashes = F.transform(lines_of(F.col(text)), lambda line: line_hash(line, min_chars))
    known = F.col(id).isNotNull()
    batch = F.pmod(F.when(known, F.xxhash64(F.col(id), F.lit("batch"))).otherwise(F.xxhash64(F.col(text), F.lit("batch"))), F.lit(batches)).cast("int").alias("batch")
    rows = docs.select(F.xxhash64(F.col(id)).alias("k1"), F.xxhash64(F.col(text)).alias("k2"), known.alias("known"), hashes.alias("hashes"), batch)
    folder = new_folder(docs.sparkSession, "line-hashes")
    rows.write.partitionBy("batch").parquet(folder)
    return docs.sparkSession.read.schema(rows.schema).parquet(folder)


def repeated_ids(hashed: DataFrame, most_rows: int = 1_000_000) -> DataFrame | None:
    """(k1) of the ids that several rows have, staged and broadcast if they are few; None if there are none."""
    many = stage(hashed.where("known").groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1"), "repeated-ids")
    n = many.count()
    return None if n == 0 else F.broadcast(many) if n <= most_rows else many


def document_lines(hashed: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(h1, h2) once per document and line key: the rows of one id are one document, a row without an id is its own."""
    once = F.explode(F.array_distinct("hashes")).alias("h")
    if repeated is None:
        return hashed.select(once).where("h IS NOT NULL").select("h.h1", "h.h2")
    shared = hashed.where("known").join(repeated, "k1", "left_semi").select("k1", once).where("h IS NOT NULL").select("k1", "h.h1", "h.h2").distinct()
    alone = hashed.where("NOT known").unionByName(hashed.where("known").join(repeated, "k1", "left_anti").select(*hashed.columns))
    return document_lines(alone, None).unionByName(shared.select("h1", "h2"))


def frequent_lines(hashed: DataFrame, min_docs: int, batches: int, runs: LineRuns | None = None) -> DataFrame:
    """Hashes (h1, h2) of the line keys found in at least ``min_docs`` documents, staged; one batch is taken in after the other.

    ``runs`` brings the lines of earlier documents along, and keeps those of these.
    """
    store = runs or LineRuns(hashed.sparkSession, min_docs)
    repeated = repeated_ids(hashed)
    for batch in range(batches):
        store.add(document_lines(hashed.where(F.col("batch") == batch), repeated))
    out = stage(store.frequent(), "frequent-lines")
    if runs is None:
        store.close()
    return out


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, runs: LineRuns | None = None) -> DataFrame:
    """``docs`` with every line removed from ``text`` whose key is found in at least ``min_docs`` documents, plus n_lines and n_dropped.

    Lines are hashed once; only hashes and positions of frequent lines are joined, and a text moves once, to meet its positions. A
    NULL or empty text is one empty line; keys under ``min_chars`` code points always stay; a text whose lines all go becomes
    empty, and its row stays. Rows that share an id are one document and count a key once; a row with a NULL id is a document of its own;
    equal rows get the same result. With ``runs``, a store that lasts, the documents of earlier calls count too, and these are added to
    them; no document should be given twice. Other columns pass through, whatever their names; if ``docs`` has an n_lines or n_dropped, the new column gets
    underscores in front.
    """
    n_lines, n_dropped, k1, k2, gone, done = fresh(docs, "n_lines", "n_dropped", "row_key_1", "row_key_2", "positions_gone", "lines_done")
    hashed = hashed_lines(docs, id, text, min_chars, batches)
    frequent = frequent_lines(hashed, min_docs, batches, runs)
    keyed = docs.select("*", F.xxhash64(F.col(id)).alias(k1), F.xxhash64(F.col(text)).alias(k2))
    places = hashed.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.posexplode("hashes").alias("pos", "h")).where("h IS NOT NULL").select(k1, k2, "pos", "h.h1", "h.h2")
    dropped = places.join(frequent, HASH, "left_semi").groupBy(k1, k2).agg(F.collect_set("pos").alias(gone))
    lost = F.coalesce(F.col(gone), F.array().cast("array<int>"))

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        return F.struct(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(lines).cast("long").alias("n"))

    # the lines enter a lambda, so that each text is split once
    met = keyed.join(dropped, [k1, k2], "left").withColumn(done, F.get(F.transform(F.array(lines_of(F.col(text))), rest), F.lit(0)))
    out = [F.col(f"{done}.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return met.select(*out, F.col(f"{done}.n").alias(n_lines), F.size(lost).cast("long").alias(n_dropped))
