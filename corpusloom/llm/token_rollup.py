"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A change is an insert, a delete or a revision of a document's count; each becomes signed rows (documents, tokens). A batch is
added up and written to a folder of its own, then committed by a marker. Totals are sums over committed batches, so a batch that
is applied twice counts once, one that broke off counts not at all, and nothing is rewritten but its own folder.
"""

from __future__ import annotations

import base64

import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, text_of
from corpusloom.session import materialize, scratch_path

FOLDER = "/opt/tokenizers"
#: Version name -> vocabulary file with ranks.
VERSIONS = {"byte-50k": "byte_bpe_50k.tiktoken", "multi-50k": "byte_bpe_multi_50k.tiktoken"}
#: How texts are cut before merging; the public pattern of these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ("source", "lang", "version")

_CHANGE = "source string, lang string, version string, documents bigint, tokens bigint"
_MARK = "batch string, changes bigint"


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def token_counts(docs: DataFrame, columns: list[str], folder: str = FOLDER, versions: dict[str, str] = VERSIONS) -> DataFrame:
    """``docs`` with ``n_<column>``, the array of token counts by version of each text column (null for a null text).

    The driver reads the vocabularies, whose files bound what is sent to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast([_ranks(f"{folder}/{name}") for name in versions.values()])
    coders: list[tiktoken.Encoding] = []
    at = [docs.columns.index(c) for c in columns]

    def count(text: str | None) -> list[int] | None:
        return None if text is None else [len(coder.encode_ordinary(text)) for coder in coders]

    def work(*values):
        if not coders:
            coders.extend(
                tiktoken.Encoding(str(k), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) for k, ranks in enumerate(shared.value)
            )
        return [v for k, v in enumerate(values) if k not in at] + [[count(t) for t in values[k]] for k in at]

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in columns]
    return map_batches(docs, ", ".join([*rest, *(f"n_{c} array<bigint>" for c in columns)]), work)


class Rollup:
    """A folder of committed deltas."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{part}")

    def committed(self) -> DataFrame:
        return self._read("commits", _MARK)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Add ``changes(source, lang, version, documents, tokens)``, signed; False if the batch was committed before.

        Null keys are a group of their own; rows without a count change the number of documents only.
        """
        if self.committed().where(F.col("batch") == batch).limit(1).count():
            return False
        summed = changes.groupBy(*KEYS).agg(
            F.sum("documents").cast("long").alias("documents"), F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens")
        )
        folder = f"{self.path}/deltas/{batch}"
        summed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(folder)
        n = self.spark.read.parquet(folder).count()
        self.spark.createDataFrame([(batch, n)], _MARK).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch}")
        return True

    def totals(self) -> DataFrame:
        """``(source, lang, version, documents, tokens)``; groups that have come down to no documents and tokens are left out."""
        deltas = self._read("deltas", f"{_CHANGE}, batch string").join(self.committed().select("batch"), "batch", "left_semi")
        summed = deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.where("documents <> 0 or tokens <> 0")


def signed(counts: DataFrame, column: str, sign: int, documents: int = 1, versions: dict[str, str] = VERSIONS) -> DataFrame:
    """Rows of a change: every version's count of ``column``, times ``sign``."""
    pairs = F.array(*(
        F.struct(F.lit(name).alias("version"), F.get(F.col(column), F.lit(k)).alias("n")) for k, name in enumerate(versions)
    ))
    return counts.select("source", "lang", F.explode(pairs).alias("v")).select(
        "source", "lang", "v.version", F.lit(sign * documents).cast("long").alias("documents"), (sign * F.col("v.n")).alias("tokens")
    )


def maintained_totals(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals of ``docs`` after three batches: all inserted, texts with repeated lines revised to one of each, toxic ones deleted.

    The last batch is sent twice, as after a lost acknowledgement. Null texts count no tokens. A document labelled toxic in any
    row of ``labels`` is deleted with all rows of its doc_id. Only these columns are read: doc_id, text, lang, source.
    """
    text = text_of()
    revised = F.array_join(F.array_distinct(F.split(text, "\n")), "\n")
    both = docs.select("doc_id", "source", "lang", text.alias("text"), F.when(revised != text, revised).alias("revised"))
    counts = materialize(token_counts(both, ["text", "revised"]), "tokens")
    changed = counts.where("n_revised is not null")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("__id")).distinct()
    gone = counts.join(toxic, F.col("doc_id") == F.col("__id"), "left_semi").withColumn("n_last", F.coalesce("n_revised", "n_text"))
    store = Rollup(docs.sparkSession, scratch_path(docs.sparkSession, "rollup"))
    store.apply("insert", signed(counts, "n_text", 1))
    store.apply("revise", signed(changed, "n_text", -1, 0).unionByName(signed(changed, "n_revised", 1, 0)))
    for _ in range(2):
        store.apply("delete", signed(gone, "n_last", -1))
    return store.totals()
