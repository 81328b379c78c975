"""Token counts: rollups kept up to date by signed deltas.

A change says what a document's count was and what it is now.  It becomes at most two signed
rows: minus the old figures under the old (source, lang, tokenizer_version), plus the new ones
under the new key.  Totals are sums of signed rows, so a batch touches only the
keys that it changes, and batches can be added in any order.

A batch is aggregated first (map-side, so a hot source is one row per task and key) and written
to a data folder of its own.  What counts is named by small manifest files: ``commits/<batch>`` is
made, exclusively, after the data is complete and holds the data folder's name.  So an unfinished data
folder counts nothing, no rename is relied on, and a batch that is sent again, or retried after a
crash at any point, counts once.  A manifest without its closing line break was never finished: it
counts nothing and the next commit of that batch replaces it.

``compact`` writes the totals of a base and the manifests that it folds in, then ``base/<number>`` as the
base's manifest, and last moves the folded manifests to ``folded/`` and deletes their data.  A crash
between these steps is mended by the next ``compact``; readers skip what the newest base names.
One job compacts at a time; any number may commit meanwhile.

Edge cases: a NULL source, lang or version is a key of its own; a NULL count is 0; a change with neither
old nor new figures adds nothing; keys whose documents, characters and tokens are all back at
zero are left out of the totals; an empty batch commits as empty.  Repeated rows count each
time.  Only the columns named here are read from a batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_chars", "n_tokens")
SCHEMA = ", ".join([f"{k} string" for k in KEYS] + [f"{s} long" for s in SUMS])


def _side(keys: dict, chars, tokens):
    return F.struct(*[keys[k].cast("string").alias(k) for k in KEYS], chars.cast("long").alias("n_chars"), tokens.cast("long").alias("n_tokens"))


def state(source: str, lang: str, version, chars, tokens):
    """A struct column with a document's key and figures, for ``old`` or ``new`` of a change."""
    return _side({"source": F.col(source), "lang": F.col(lang), "tokenizer_version": version}, chars, tokens)


def signed(changes: DataFrame) -> DataFrame:
    """``changes`` has the struct columns ``old`` and ``new`` (see ``state``); an insert has a
    NULL ``old``, a delete a NULL ``new``, a revision both.  Returns summed signed rows."""
    sides = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("s")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("s")))
    rows = changes.select(F.explode(F.filter(sides, lambda x: x["s"].isNotNull())).alias("x")).select("x.sign", "x.s.*")
    return rows.groupBy(*KEYS).agg(
        F.sum("sign").cast("long").alias("n_docs"),
        *[F.coalesce(F.sum(F.col("sign") * F.col(c)), F.lit(0)).cast("long").alias(c) for c in SUMS[1:]])


def later_copies(docs: DataFrame, id_col: str, digest_col: str, salts: int = 64) -> DataFrame:
    """The rows of ``docs`` whose digest a row with a smaller id has.  The first ids of repeated digests are
    written once per salt, so a group of copies that holds a third of all rows is spread over ``salts`` keys.
    Rows without an id are never copies."""
    key, digest = F.col(f"`{id_col}`"), F.col(f"`{digest_col}`")
    first = (docs.groupBy(digest.alias("_d")).agg(F.min(key).alias("_first"), F.max(key).alias("_last")).where("_first <> _last")
             .select("_d", "_first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s")))
    salted = docs.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    return (salted.join(first, (digest == F.col("_d")) & (F.col("_salt") == F.col("_s")))
            .where(key > F.col("_first")).drop("_d", "_s", "_first", "_salt"))


class Ledger:
    """Committed batches in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        p = self._at(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _read(self, name: str) -> list[str] | None:
        """The lines of a manifest; None where there is none or it was never finished."""
        if not self._fs.exists(self._at(name)):
            return None
        source = self._fs.open(self._at(name))
        try:
            text = bytes(source.readAllBytes()).decode()
        finally:
            source.close()
        return text.splitlines() if text.endswith("\n") else None

    def _create(self, name: str, lines: list[str]) -> bool:
        """Makes a manifest; false if another writer has made it."""
        from py4j.protocol import Py4JJavaError
        self._fs.mkdirs(self._at(name).getParent())
        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError:
            if self._fs.exists(self._at(name)):
                return False
            raise
        try:
            out.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
        finally:
            out.close()
        return True

    def _base(self) -> tuple[str | None, dict[str, str]]:
        """The newest base's folder and what it folded in: data folder by batch."""
        for name in reversed(self._names("base")):
            lines = self._read(f"base/{name}")
            if lines is not None:
                return lines[0], dict(x.split("/", 1) for x in lines[1:])
        return None, {}

    def _live(self, folded: dict[str, str]) -> dict[str, str]:
        """Data folder by committed batch that no base holds."""
        found = {b: self._read(f"commits/{b}") for b in self._names("commits") if b not in folded}
        return {b: lines[0] for b, lines in found.items() if lines}

    def is_committed(self, batch_id: str) -> bool:
        return self._read(f"commits/{batch_id}") is not None or self._fs.exists(self._at(f"folded/{batch_id}"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; false, and no change, if ``batch_id`` is committed already."""
        if not batch_id or "/" in batch_id or "\n" in batch_id or batch_id.startswith((".", "_")):
            raise ValueError("a batch id is a plain file name")
        if self.is_committed(batch_id):
            return False
        data = f"data/{batch_id}-{uuid.uuid4().hex[:12]}"
        signed(changes).write.parquet(f"{self.path}/{data}")
        manifest = f"commits/{batch_id}"
        if self._fs.exists(self._at(manifest)) and self._read(manifest) is None:
            self._fs.delete(self._at(manifest), False)
        if not self.is_committed(batch_id) and self._create(manifest, [data]):
            return True
        self._fs.delete(self._at(data), True)
        return False

    def _sums(self, base: str | None, live: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/{d}" for d in [*live.values(), *([base] if base else [])]]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where(" OR ".join(f"{c} <> 0" for c in SUMS))

    def totals(self) -> DataFrame:
        base, folded = self._base()
        return self._sums(base, self._live(folded))

    def compact(self) -> None:
        """Writes a new base with all that is committed now, and removes what it replaces."""
        base, folded = self._base()
        self._retire(folded)
        live = self._live(folded)
        data = f"data/base-{uuid.uuid4().hex[:12]}"
        self._sums(base, live).write.parquet(f"{self.path}/{data}")
        names = self._names("base")
        if not self._create(f"base/{int(names[-1]) + 1 if names else 0:012d}", [data, *[f"{b}/{d}" for b, d in live.items()]]):
            raise RuntimeError("another job compacts this ledger")
        self._retire(live)
        if base:
            self._fs.delete(self._at(base), True)

    def _retire(self, folded: dict[str, str]) -> None:
        """Moves folded manifests away, marker first, and deletes their data."""
        for batch, data in folded.items():
            self._create(f"folded/{batch}", [data])
            self._fs.delete(self._at(f"commits/{batch}"), False)
            self._fs.delete(self._at(data), True)
