"""Token counts as delta-maintained rollups.

A change to the corpus is a batch of signed deltas: an insert adds a document's count, a delete takes it
away, a revised count is both.  Totals by source, language and tokenizer version are additive, so a batch is
summed before it is shuffled, and added to the last totals; unchanged documents are never read again.  A batch has
an id and is committed once, by a marker that only one writer can create: a second commit of the id changes
nothing, and one with other deltas is refused.
"""

from __future__ import annotations

import base64
import re
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.scratch import Scratch, prepare_python

#: Fixed value: the pattern that cuts text before merging, as published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ("source", "lang", "tokenizer")
TOTAL = "source string, lang string, tokenizer string, documents bigint, tokens bigint"
BATCHES = "batch string, digest string"
TOKENIZERS = "/opt/tokenizers"
#: Characters of a text encoded at once.  A cut is made before a space that follows a letter, where the pattern always cuts.
PIECE = 1 << 16
#: Seconds that the data of a version stays after a later version is there.
KEEP_S = 86_400.0


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut > at + 1 and not (text[cut] == " " and text[cut - 1].isascii() and text[cut - 1].isalpha()):
            cut -= 1
        if cut == at + 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(docs: DataFrame, vocabularies: dict[str, str], *, text_col: str = "text", which: dict[str, Column] | None = None) -> DataFrame:
    """Columns of ``docs`` without the text, and one count per vocabulary (name -> file of ranks), which replaces a column of its name.

    Counts are of whole texts; null and empty texts have 0 tokens.  ``which`` may hold a condition per name:
    rows that do not meet it get a null count and are not encoded.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    raw = {}
    for name, path in vocabularies.items():
        with open(path, "rb") as f:
            raw[name] = f.read()
    sent = spark.sparkContext.broadcast(raw)  # about a megabyte for each vocabulary, whatever the corpus
    which = which or {}
    flags = [F.coalesce(which.get(n, F.lit(True)), F.lit(False)).alias(f"__do_{k}") for k, n in enumerate(raw)]
    rest = [c for c in docs.columns if c != text_col and c not in raw]
    names = list(raw)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        made = {}
        for n, data in sent.value.items():
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
            made[n] = tiktoken.Encoding(n, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            columns = [batch.column(c) for c in rest]
            for k, n in enumerate(names):
                do = batch.column(f"__do_{k}").to_pylist()
                counts = [sum(len(made[n].encode_ordinary(p)) for p in _pieces(t or "")) if d else None for t, d in zip(texts, do, strict=True)]
                columns.append(pa.array(counts, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, *[f"__n_{k}" for k in range(len(names))]])

    base = docs.select(*rest, *flags, F.col(text_col).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema]
    out = base.mapInArrow(encode, ", ".join([*fields, *[f"`__n_{k}` bigint" for k in range(len(names))]]))
    return out.select(*rest, *[F.col(f"__n_{k}").alias(n) for k, n in enumerate(names)])


def inserts(counts: DataFrame, tokens: str, tokenizer: str) -> DataFrame:
    """Deltas that add documents with ``tokens`` tokens each."""
    n = F.col(tokens).cast("bigint")
    return counts.where(n.isNotNull()).select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("bigint").alias("documents"), n.alias("tokens"))


def deletes(counts: DataFrame, tokens: str, tokenizer: str) -> DataFrame:
    """Deltas that take documents away."""
    return inserts(counts, tokens, tokenizer).withColumn("documents", -F.col("documents")).withColumn("tokens", -F.col("tokens"))


def revisions(old: DataFrame, old_tokens: str, old_tokenizer: str, new: DataFrame, new_tokens: str, new_tokenizer: str) -> DataFrame:
    """Deltas that replace counts; documents whose count stays the same cancel out in the sums, without a join."""
    return deletes(old, old_tokens, old_tokenizer).unionByName(inserts(new, new_tokens, new_tokenizer))


class TokenRollup:
    """Totals kept below ``path``, a folder that all machines share.

    A version is a marker file ``v<n>`` that names a data folder: ``totals``, the sums of all batches so far, and ``batches``, the ids
    of those batches with a digest of their sums.  A commit reads the last marker once; on that version's batches and totals it
    builds its own data folder, and then publishes the next marker by a step that exactly one writer can take (a hard link on a local or
    mounted disk, else a rename that refuses to overwrite).  A writer that comes second starts again from the new last version.  What
    a commit that died leaves behind is never read.  A version's data stays for ``keep_s`` seconds after a later one is there, so
    that readers can end; then the next commit deletes it.
    """

    def __init__(self, spark: SparkSession, path: str, *, keep_s: float = KEEP_S):
        self.spark, self.path, self.keep_s = spark, path.rstrip("/"), keep_s

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _markers(self) -> list[tuple[int, float]]:
        """Version numbers, ascending, with the seconds at which they were published."""
        files, root = self._hadoop(self.path)
        found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in files.listStatus(root)] if files.exists(root) else []
        return sorted((int(n[1:]), t) for n, t in found if re.fullmatch(r"v[0-9]+", n))

    def _last(self) -> tuple[int, str | None]:
        """Number and data folder of the last version; 0 and None before the first."""
        version = max((n for n, _ in self._markers()), default=0)
        return version, self._folder(version) if version else None

    def _marker(self, version: int) -> str:
        return f"{self.path}/v{version:012d}"

    def _folder(self, version: int) -> str:
        files, where = self._hadoop(self._marker(version))
        stream = files.open(where)
        try:
            return f"{self.path}/{self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
        finally:
            stream.close()

    def _publish(self, draft: str, version: int) -> bool:
        """Make the file ``draft`` the marker of ``version``; False if another writer did so first."""
        files, source = self._hadoop(draft)
        target = self._hadoop(self._marker(version))[1]
        jvm = self.spark._jvm
        try:
            if files.getScheme() == "file":
                local = [jvm.java.nio.file.Paths.get(files.makeQualified(p).toUri()) for p in (target, source)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, none)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def _table(self, folder: str | None, name: str, schema: str) -> DataFrame:
        if folder is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{folder}/{name}")

    def _digest(self, folder: str | None, batch_id: str) -> str | None:
        row = self._table(folder, "batches", BATCHES).where(F.col("batch") == batch_id).first()
        return row["digest"] if row else None

    def committed(self, batch_id: str) -> str | None:
        """Digest of the batch's sums if it counts."""
        return self._digest(self._last()[1], batch_id)

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch of deltas once; False if it was there already.  A null key is a key of its own.

        An id that was committed with other sums raises ValueError.
        """
        own = f"data-{uuid.uuid4().hex}"
        folder = f"{self.path}/{own}"
        files, where = self._hadoop(folder)
        _added(deltas).write.parquet(f"{folder}/batch")
        sums = self.spark.read.schema(TOTAL).parquet(f"{folder}/batch")
        found = sums.agg(F.sum(F.xxhash64(*sums.columns).cast("decimal(38,0)")), F.count(F.lit(1))).first()
        digest = f"{found[0] or 0}:{found[1]}"
        done = False
        try:
            while not done:
                version, last = self._last()  # batches, totals and the next number all follow from this one look
                known = self._digest(last, batch_id)
                if known is not None:
                    if known != digest:
                        raise ValueError(f"batch {batch_id!r} was committed with other deltas")
                    return False
                _added(self._table(last, "totals", TOTAL).unionByName(sums)).write.mode("overwrite").parquet(f"{folder}/totals")
                mine = self.spark.createDataFrame([(batch_id, digest)], BATCHES)
                self._table(last, "batches", BATCHES).unionByName(mine).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches")
                draft = f"{folder}/marker-{version + 1}"
                stream = files.create(self._hadoop(draft)[1], True)
                stream.write(bytearray(own.encode()))
                stream.close()
                done = self._publish(draft, version + 1)
        finally:
            if not done:
                files.delete(where, True)
        self._sweep()
        return True

    def _sweep(self) -> None:
        """Delete versions that were followed by another one ``keep_s`` seconds ago or more."""
        markers = self._markers()
        now = time.time()
        for (version, _), (_, followed) in zip(markers, markers[1:]):
            if now - followed >= self.keep_s:
                try:
                    files, data = self._hadoop(self._folder(version))
                except Py4JJavaError as e:
                    if e.java_exception.getClass().getSimpleName() == "FileNotFoundException":
                        continue  # another writer deleted it
                    raise
                files.delete(data, True)
                files.delete(self._hadoop(self._marker(version))[1], False)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens of the last version; keys whose documents have all gone are left out."""
        return self._table(self._last()[1], "totals", TOTAL)


def _added(rows: DataFrame) -> DataFrame:
    """Sums by key, without those that are 0."""
    sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return sums.where("documents <> 0 or tokens <> 0")


def maintain(docs: DataFrame, labels: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Totals after three batches: all documents are loaded under one vocabulary, those not in English are
    recounted under a multilingual one, and documents labelled toxic are withdrawn.

    The first batch is committed twice, as after a lost answer, and counts once.  Documents of null id stay.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "rollup")
    plain, multi = "byte_bpe_50k", "byte_bpe_multi_50k"
    foreign = F.col("lang").isNull() | (F.col("lang") != "en")
    files = {n: f"{tokenizers.rstrip('/')}/{n}.tiktoken" for n in (plain, multi)}
    counts = count_tokens(docs.select("doc_id", "source", "lang", "text"), files, which={multi: foreign})
    counts = scratch.table(counts, "counts")
    rollup = TokenRollup(spark, scratch.path("totals"))
    rollup.commit("load", inserts(counts, plain, plain))
    rollup.commit("load", inserts(counts, plain, plain))
    other = counts.where(foreign)
    rollup.commit("recount", revisions(other, plain, plain, other, multi, multi))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    gone = counts.join(toxic, "doc_id", "left_semi")
    english, rest = gone.where(~foreign), gone.where(foreign)
    rollup.commit("withdraw", deletes(english, plain, plain).unionByName(deletes(rest, multi, multi)))
    return rollup.totals()
