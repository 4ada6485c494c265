"""Token totals by source, language and tokenizer version, kept up by signed deltas."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import token_bytes
from tallyflow.sources.runs import Runs

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def token_count(tokenizer: str, end_tokens: int = 0) -> Callable[[Column], Column]:
    """Tokens of a whole text by a vocabulary file; null counts as empty."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(t) // 4 + end_tokens for t in token_bytes(tokenizer, texts)], pa.int64())

    return lambda text: F.arrow_udf(count, "bigint")(F.coalesce(text, F.lit("")))


class TokenRollup:
    """Totals in a folder that all executors share.

    A batch of changes is summed by key and committed once under its id, as a run of its own
    (:class:`tallyflow.sources.runs.Runs`): one that failed half-way left nothing that counts, and of two writers of an id one
    counts. Totals are additive, so batches may come in any order. ``compact`` folds the
    batches that one listing finds into one table and remembers their ids; batches committed
    meanwhile stay batches.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.runs = spark, Runs(spark, root)

    def _listed(self) -> tuple[int, str | None, dict[str, str]]:
        """From one listing: the newest folded table's number and folder, and the folders of the batches that are not in it, by id."""
        found = self.runs.committed()
        bases = {int(name[5:]): folder for name, folder in found.items() if name.startswith("base-")}
        batches = {name[6:]: folder for name, folder in found.items() if name.startswith("batch-")}
        if not bases:
            return 0, None, batches
        newest = max(bases)
        folded = {r.batch for r in self._names(bases[newest]).collect()}
        return newest, bases[newest], {b: folder for b, folder in batches.items() if b not in folded}

    def _names(self, base: str) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{base}/batches")

    def committed(self) -> list[str]:
        _, base, batches = self._listed()
        return sorted(set(batches) | ({r.batch for r in self._names(base).collect()} if base else set()))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it is committed already.

        ``changes`` has ``op, source, lang, tokenizer, tokens``, for revised counts
        ``old_tokens``, and may have ``docs``, the equal documents a row stands for.
        ``insert`` adds a document and its tokens, ``delete`` takes them back,
        ``revise`` replaces a count; any other op is an error. Null sources, languages and
        tokenizers are values of their own; null counts are 0.
        """
        name = Runs.name(batch_id)
        if name in self.committed():
            return False
        has = lambda c, otherwise: F.coalesce(F.col(c).cast("long"), F.lit(otherwise)) if c in changes.columns else F.lit(otherwise)
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
        sign = F.when(sign.isNull(), F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null"))))).otherwise(sign)
        tokens, docs = has("tokens", 0), has("docs", 1)
        more = F.when(F.col("op") == "revise", tokens - has("old_tokens", 0)).otherwise(sign * tokens)
        rows = changes.select(*KEYS, (sign * docs).cast("long").alias("n_docs"), (more * docs).cast("long").alias("n_tokens"))
        rows = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return self.runs.append(f"batch-{name}", rows)

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` of everything committed; keys that came to nothing are left out."""
        _, base, batches = self._listed()
        return self._summed(base, batches)

    def _summed(self, base: str | None, batches: dict[str, str]) -> DataFrame:
        rows = self.runs.read(TOTALS, [*batches.values(), *([f"{base}/totals"] if base else [])])
        rows = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return rows.filter("n_docs != 0 or n_tokens != 0")

    def compact(self) -> None:
        number, base, batches = self._listed()
        folder = self.runs.fresh()
        self._summed(base, batches).write.parquet(f"{folder}/totals")
        names = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        (names.unionAll(self._names(base)) if base else names).coalesce(1).write.parquet(f"{folder}/batches")
        self.runs.mark(f"base-{number + 1}", folder)
