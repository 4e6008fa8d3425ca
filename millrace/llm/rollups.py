"""Delta-maintained rollups of token counts by source, language and tokenizer version.

A batch is the signed change of documents and tokens for each key that it touches. Its rows are written
aside; then a small marker file that names them is renamed to the batch's own name, which fails if that
name is there: of two writers of one batch, or of an attempt that runs again, one alone counts. Totals
are the sum of the committed batches. A snapshot sums up what is committed, by the same rename, and names
the batches in it, so that totals read one snapshot and the batches after it.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEYS = ["source", "lang", "tokenizer"]
ROLLUP = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

# ---- counts

_counters: dict[str, Callable[[list[str | None]], list[int]]] = {}


def counter(path: str) -> Callable[[list[str | None]], list[int]]:
    """The number of ids of each text (null or empty: 0) by a tokenizers file (.json) or ranks (.tiktoken); one for each worker."""
    if path not in _counters:
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _counters[path] = lambda texts: [len(encode(t)) if t else 0 for t in texts]
        else:
            from .tokens import encoder

            _counters[path] = lambda texts: encoder(path).encode(texts)[1].tolist()
    return _counters[path]


def token_counts(docs: DataFrame, path: str, name: str, where: Column | None = None) -> DataFrame:
    """docs with their text replaced by name, its number of tokens; 0 for a null or empty text and for rows that where leaves out."""
    names, at = docs.columns, common.place_of(docs, "text")
    marked = docs.withColumn(common.unused(docs, "counted"), F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    out = [(name if i == at else n) for i, n in enumerate(names)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_tokens = counter(path)
        for batch in common.slices(batches, at, 1 << 20):
            texts = [t if k else None for t, k in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            columns = [pa.array(n_tokens(texts), pa.int64()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, out)

    kinds = ["long" if i == at else f.dataType.simpleString() for i, f in enumerate(docs.schema)]
    return common.bounded(marked).mapInArrow(count, ", ".join(f"`{n}` {k}" for n, k in zip(out, kinds, strict=True)))


# ---- the store


def counted(tokenizer: str, n: Column) -> Column:
    """One document's count, as changes hold it; source and lang are columns of the row."""
    return F.struct(F.col("source"), F.col("lang"), F.lit(tokenizer).alias("tokenizer"), n.alias("n_tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens: the signed sums of changes (before, after: counted() or null).

    An insert has no before, a delete no after, a revised count both: the old count is taken off its
    key and the new one added to its own. Rows with neither change nothing; null keys are keys; what
    adds up to zero is left out. A frequent key is summed before it is shuffled.
    """
    signed = F.filter(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("c")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("c"))), lambda x: x["c"].isNotNull())
    rows = changes.select(F.explode(signed).alias("x")).select(*[F.col(f"x.c.{k}").alias(k) for k in KEYS], F.col("x.sign").cast("long").alias("sign"), F.coalesce("x.c.n_tokens", F.lit(0)).alias("n"))
    sums = rows.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")


class RollupStore:
    """A folder on any of Hadoop's file systems whose rename is atomic."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop

    def _fs(self, path: str):
        p = self.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _marks(self, kind: str) -> dict[str, str]:
        """Names of the markers of a kind, and what each says."""
        fs, p = self._fs(f"{self.folder}/{kind}")
        if not fs.exists(p) or not fs.listStatus(p):
            return {}
        rows = self.spark.read.text(str(p), wholetext=True).collect()  # one row a batch
        return {x["name"]: x["says"] for x in (json.loads(r["value"]) for r in rows)}

    def _publish(self, kind: str, name: str, says: str) -> bool:
        """Writes a marker under its name, unless that name is there; whether it was written now."""
        fs, aside = self._fs(f"{self.folder}/aside/{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps({"name": name, "says": says}).encode()))
        out.close()
        target = self.hadoop.fs.Path(f"{self.folder}/{kind}/named-{quote(name, safe='')}")
        fs.mkdirs(target.getParent())
        context = self.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self.hadoop.fs.Options.Rename, 1)
        options[0] = self.hadoop.fs.Options.Rename.NONE  # an existing target is an error
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(target), options)
        except Exception:
            fs.delete(aside, False)
            if fs.exists(target):
                return False
            raise
        return True

    def _has(self, kind: str, name: str) -> bool:
        fs, p = self._fs(f"{self.folder}/{kind}/named-{quote(name, safe='')}")
        return fs.exists(p)

    def committed(self) -> list[str]:
        """Names of committed batches, sorted."""
        return sorted(self._marks("batches"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch of changes once, whatever is given under its name later; whether it was applied now.

        Any text but an empty one names a batch. No change at all is a batch too.
        """
        if not batch:
            raise ValueError("a batch needs a name")
        if self._has("batches", batch):
            return False
        path = f"{self.folder}/rows/{uuid.uuid4().hex}"
        deltas(changes).coalesce(1).write.parquet(path)  # at most a row for each key
        if self._publish("batches", batch, path):
            return True
        fs, p = self._fs(path)
        fs.delete(p, True)  # another writer was first
        return False

    def _sums(self, batches: dict[str, str], last: dict) -> DataFrame:
        """The totals of just these batches (name to path), of which those that last, a snapshot, holds are read from it."""
        paths = [p for b, p in sorted(batches.items()) if b not in {*last["batches"]}] + ([last["path"]] if last["path"] else [])
        rows = self.spark.read.schema(ROLLUP).parquet(*paths) if paths else self.spark.createDataFrame([], ROLLUP)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def _last(self) -> tuple[int, dict]:
        """The newest snapshot's number, and what it says: its path and its batches."""
        snapshots = self._marks("snapshots")
        newest = max(map(int, snapshots), default=0)
        return newest, json.loads(snapshots[str(newest)]) if newest else {"path": None, "batches": []}

    def snapshot(self) -> int:
        """Sums up committed batches in a new snapshot; how many batches it holds, or 0 if another writer's took its number.

        One list of batches is taken, and the snapshot holds those, whatever is committed meanwhile. Old snapshots stay until no reader
        needs them.
        """
        newest, last = self._last()  # before the list: what it holds is in the list
        batches, path = self._marks("batches"), f"{self.folder}/rows/{uuid.uuid4().hex}"
        self._sums(batches, last).coalesce(1).write.parquet(path)
        if self._publish("snapshots", str(newest + 1), json.dumps({"path": path, "batches": sorted(batches)})):
            return len(batches)
        fs, p = self._fs(path)
        fs.delete(p, True)
        return 0

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all committed batches; keys without documents or tokens are left out."""
        _, last = self._last()
        return self._sums(self._marks("batches"), last)
