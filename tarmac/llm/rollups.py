"""Token totals kept by signed changes: inserts, deletes and revised counts, committed in batches that count once.

A store is a folder of written batches. Each batch holds the signed changes summed by source, language and tokenizer version, and
the newest state of every document it touched. A batch counts when its marker exists; a batch that is already there is not
written again, so a repeated commit changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.tables import column
from tarmac.llm.tokens import ChunkEncoder

KEYS = ("source", "lang", "version")
STATE = "id {kind}, version string, source string, lang string, tokens bigint, present boolean"


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = ChunkEncoder(path)
    for batch in batches:
        counts = [len(ids) // 4 for ids in encoder.ids_of(text.as_py() or "" for text in batch.column(3))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64())], names=["id", "source", "lang", "tokens"])


def token_counts(df: DataFrame, path: str, id_column: str = "doc_id", source_column: str = "source", lang_column: str = "lang",
                 text_column: str = "text") -> DataFrame:
    """id, source, lang, tokens of every row by the word tokenizer at ``path``; a null text has none."""
    kind = df.schema[id_column].dataType.simpleString()
    return df.select(*(F.col(column(name)) for name in (id_column, source_column, lang_column, text_column))).mapInArrow(
        lambda batches: _counted(batches, path), f"id {kind}, source string, lang string, tokens bigint")


class Rollup:
    """Totals in ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint"):
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), id_type

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Numbers of the batches that count, in order."""
        if not self._files().exists(self._path("markers")):
            return []
        return sorted(int(status.getPath().getName()) for status in self._files().listStatus(self._path("markers")))

    def state(self, touched: DataFrame | None = None) -> DataFrame:
        """The newest row of every document and version, or of the ``touched`` ones; a later batch stands above an earlier one."""
        batches = self.committed()
        schema = STATE.format(kind=self.kind)
        if not batches:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch bigint").parquet(*(f"{self.folder}/state/{n}" for n in batches))
        if touched is not None:
            rows = rows.join(touched, ["id", "version"], "left_semi")
        newest = F.max_by(F.struct("source", "lang", "tokens", "present"), "batch")
        return rows.groupBy("id", "version").agg(newest.alias("now")).select("id", "version", "now.*")

    def commit(self, batch: int, changes: DataFrame, unnamed: bool = False) -> bool:
        """Apply changes (id, version, source, lang, tokens; null tokens delete) as batch number ``batch``.

        False, and nothing changes, when the batch is already there or not newer than the last. A document that the state does not know
        is inserted, a known one gets its revised count, source and language, of which null leaves the old one; deleting an unknown one
        changes nothing. Rows that repeat id and version in one batch count once, by the largest (tokens, source, lang), a delete only
        if nothing else is said. A null version is the empty one. A null id cannot be told apart later: the batch is refused, or
        with ``unnamed`` each such row counts as a document of its own, which no later change can revise or delete; without
        tokens it deletes nothing. An empty batch is committed as such.
        """
        known = self.committed()
        if known and batch <= known[-1]:
            return False
        # Rows without an id are added up by source and language, so that the changes are read once.
        told = changes.withColumns({
            "version": F.coalesce("version", F.lit("")),
            "_source": F.when(F.col("id").isNull(), F.col("source")), "_lang": F.when(F.col("id").isNull(), F.col("lang")),
        }).groupBy("id", "version", "_source", "_lang").agg(
            F.max(F.struct("tokens", "source", "lang")).alias("new"), F.count("tokens").alias("rows"), F.sum("tokens").alias("total"),
        ).select("id", "version", "new.*", "rows", "total")
        told.write.mode("overwrite").parquet(f"{self.folder}/changes/{batch}")
        written = self.spark.read.schema(told.schema).parquet(f"{self.folder}/changes/{batch}")
        if not unnamed and not written.where("id IS NULL").isEmpty():
            raise ValueError("a change without an id")
        new = written.where("id IS NOT NULL").drop("rows", "total")
        plain = written.where("id IS NULL AND rows > 0").select(
            "version", "source", "lang", F.col("total").alias("tokens"), F.col("rows").alias("documents"))
        old = self.state(new.select("id", "version")).where("present").select(
            F.col("id").alias("_id"), F.col("version").alias("_version"),
            *(F.col(name).alias(f"old_{name}") for name in ("source", "lang", "tokens", "present")))
        both = new.join(old, (F.col("id") == F.col("_id")) & (F.col("version") == F.col("_version")), "left").withColumns({
            "source": F.coalesce("source", "old_source"), "lang": F.coalesce("lang", "old_lang")})
        both.select(
            "id", "version", "source", "lang", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"),
            F.col("tokens").isNotNull().alias("present"), F.lit(batch).cast("bigint").alias("batch"),
        ).write.mode("overwrite").parquet(f"{self.folder}/state/{batch}")
        signed = both.select("version", F.explode(F.expr("""filter(array(
            IF(old_present, struct(old_source AS source, old_lang AS lang, -old_tokens AS tokens, -1L AS documents), NULL),
            IF(tokens IS NOT NULL, struct(source, lang, tokens, 1L AS documents), NULL)), x -> x IS NOT NULL)""")).alias("x"))
        signed.select("version", "x.*").unionByName(plain).groupBy(*KEYS).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")
        ).write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch}")
        self._files().create(self._path("markers", str(batch)), True).close()
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens: sums of the committed batches; keys that have come to nothing are left out."""
        batches = self.committed()
        schema = "source string, lang string, version string, documents bigint, tokens bigint"
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/deltas/{n}" for n in batches)).groupBy(*KEYS).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 OR tokens <> 0")
