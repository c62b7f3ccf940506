"""Token counts of texts through a cache of counts by digest.

Method: digest cache. A row's key is the digest of its normalised text and the digest of the
tokenizer's version. Keys that the cache holds are answered from there; of the others every
distinct one is encoded once and appended to the cache, which answers all rows at the end.

Plan: one narrow scan stores ids and digests. Distinct digests, combined map-side, lose those
in the cache. The texts of the rest are combined by digest before they move, so a text that a
third of all documents share moves once a task and is encoded once. The closing join is between
two stored narrow tables, which Spark may split where one digest has very many rows.

The cache is a Parquet folder, ``version=<digest>/``. An append becomes visible as a whole when
its job commits. Two runs may append the same digest: equal rows, read as one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from importlib.metadata import version as library_version

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm import common as C
from filingloom.runtime import broadcast_if_small, durable, durable_root

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
# Text encoded together; chunks a worker remembers, and the longest of them.
SLICE_CHARS = 1 << 20
CACHE_CHUNKS = 400_000
CACHE_CHARS = 64
# Misses whose texts are picked by a broadcast set of digests.
FEW_MISSES = 50_000
SPACE = "▁"  # how the piece model writes a space

COUNTED = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])


def _file(tokenizer: str) -> str:
    """Path of a tokenizer file; a bare name is one of the public vocabularies."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def tokenizer_version(tokenizer: str = TOKENIZER) -> str:
    """Digest of the vocabulary file, of the library that reads it and of that library's version."""
    library = "sentencepiece" if tokenizer.endswith(".model") else "tokenizers"
    with open(_file(tokenizer), "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{library} {library_version(library)} {content}".encode()).hexdigest()[:32]


def normalised(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """The text as far as the tokenizer tells texts apart: null is empty, and a piece model
    without normalisation of its own writes spaces as U+2581, so both are one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    if tokenizer.endswith(".model") and PieceModel(_file(tokenizer)).identity:
        text = F.translate(text, SPACE, " ")
    return text


class PieceModel:
    """Counts the pieces of texts as sentencepiece does.

    A BPE model merges neighbours only into pieces of its vocabulary. Where no piece holds a
    space after another character, and none of several characters holds a line end, the text
    falls apart before spaces and around line ends, and the counts of the chunks, which are
    remembered, add up. Models of other kinds get whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        self.known: dict[str, int] = {}
        self.identity = self._identity(path)

    def _identity(self, path: str) -> bool:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, kind = model.normalizer_spec, model.trainer_spec
        plain = {1, 2, 3, 6}  # normal, unknown, control, byte
        return (
            kind.model_type == kind.BPE
            and kind.byte_fallback
            and not kind.treat_whitespace_as_suffix
            and rules.add_dummy_prefix
            and rules.escape_whitespaces
            and not rules.remove_extra_whitespaces
            and not rules.precompiled_charsmap
            and all(p.type in plain for p in model.pieces)
            and not any(self._crosses(p.piece) for p in model.pieces)
        )

    @staticmethod
    def _crosses(piece: str) -> bool:
        return SPACE in piece.lstrip(SPACE) or (len(piece) > 1 and "\n" in piece)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.identity:
            return [len(self.encode(t)) for t in texts]
        find = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        split = [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        known = self.known
        new = list(set().union(*split).difference(known))
        # a line end is one token and keeps apart what stands beside it
        framed = [c[1:] + "\n" if c[0] == SPACE else "\n" + c for c in new]
        extra = [1 if c[0] == SPACE else 2 for c in new]
        found = {c: len(ids) - x for c, ids, x in zip(new, self.encode(framed), extra, strict=True)} if new else {}
        long = {c: n for c, n in found.items() if len(c) > CACHE_CHARS}
        known.update(found)
        out = [sum(map(known.__getitem__, chunks)) for chunks in split]
        for chunk in long:
            del known[chunk]
        return out


class JsonModel:
    """Counts the tokens of texts as tokenizers does."""

    identity = False

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]


def counter(tokenizer: str = TOKENIZER):
    """The counter of a vocabulary file, kept by a worker."""
    path = _file(tokenizer)
    make = PieceModel if path.endswith(".model") else JsonModel
    return C.worker_cache(("token counts", path), lambda: make(path))


def _count(batches, tokenizer: str):
    own = counter(tokenizer)
    for batch in batches:
        digests, texts = batch.column(0), batch.column(1).to_pylist()
        counts, part, size = [], [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= SLICE_CHARS:
                counts += own.counts(part)
                part, size = [], 0
        if part:
            counts += own.counts(part)
        yield pa.RecordBatch.from_arrays([digests, pa.array(counts, pa.int64())], schema=COUNTED)


def _exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target)


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """``(digest, n_tokens)`` that the cache holds for a tokenizer version, each digest once."""
    path = f"{cache}/version={version}"
    if not _exists(spark, path):
        return None
    rows = spark.read.schema("digest binary, n_tokens long").parquet(path)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def misses(digests: DataFrame, cached: DataFrame | None) -> DataFrame:
    """The distinct digests that the cache lacks."""
    distinct = digests.select("digest").distinct()
    return distinct if cached is None else distinct.join(cached, "digest", "left_anti")


def count_tokens(
    docs: DataFrame,
    cache: str | None = None,
    tokenizer: str = TOKENIZER,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row for each row of ``docs``.

    ``cache`` is a folder that all executors share, used and extended by every run that names
    it; without one the run has a cache of its own. ``tokenizer`` is a public vocabulary's name
    or a path that every executor has. A null text counts as an empty one (0 tokens). Null and
    repeated ids are rows like others; other columns are not looked at.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    if cache is None:
        app = spark.sparkContext.applicationId
        cache = f"{durable_root(spark)}/filingloom/{app}/token-cache-{uuid.uuid4().hex}"
    text = normalised(docs[text_col], tokenizer)
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    size = F.octet_length(F.coalesce(docs[text_col].cast("string"), F.lit(""))).cast("long")
    rows = durable(docs.select(docs[id_col].alias("doc_id"), size.alias("n_bytes"), digest), "text-digests")

    cached = stored_counts(spark, cache, version)
    texts = docs.select(digest, text.alias("t"))
    distinct = F.first("t").alias("t")
    if cached is None:
        new = texts.groupBy("digest").agg(distinct)
    else:
        lacking = durable(misses(rows, cached), "missing-digests")
        if lacking.limit(FEW_MISSES + 1).count() <= FEW_MISSES:
            few = broadcast_if_small(lacking, FEW_MISSES)
            new = texts.join(few, "digest", "left_semi").groupBy("digest").agg(distinct)
        else:
            new = texts.groupBy("digest").agg(distinct).join(lacking, "digest", "left_semi")
    counted = new.mapInArrow(lambda b: _count(b, tokenizer), C.ddl(COUNTED))
    counted.write.mode("append").parquet(f"{cache}/version={version}")

    counts = durable(stored_counts(spark, cache, version), "token-counts")
    over = F.col("n_tokens") > limit
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", over.alias("over_limit"))
