"""Language identification by multilingual mixture inference.

Every language has a distribution over hashed byte n-grams, fitted on a bounded sample of labelled rows
(``sample_rows`` for each language, by hash of id and text).  A document is a mixture: expectation-maximisation
estimates its languages' proportions from n-gram likelihoods, and a language joins the set while it raises the
penalised likelihood (half a log count for each language).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import _kernels as K
from corvane.llm import _rows as R
from corvane.llm._spark import small_batches


@dataclass(frozen=True)
class LanguageConfig:
    orders: tuple[int, ...] = (1, 2, 3, 4)
    bits: int = 15
    #: Labelled rows (of different id or text) that one language's model is fitted on, at most.
    sample_rows: int = 1000
    steps: int = 12


def gram_ids(data: np.ndarray, config: LanguageConfig) -> np.ndarray:
    """Buckets of all n-grams of one lower-cased text."""
    code, out, h = data.astype(np.uint64) + np.uint64(1), [], np.zeros(len(data), np.uint64)
    for n in range(1, max(config.orders) + 1):
        if n > len(code):
            break
        h = (h[: len(code) - n + 1] << np.uint64(8)) ^ code[n - 1 :]
        if n in config.orders:
            out.append(K.mix(h + np.uint64(n * int(K._SEQ) % (1 << 64))) >> np.uint64(64 - config.bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class LanguageModel:
    names: list[str]
    #: (bucket, language) log-probabilities.
    logs: np.ndarray

    def mixture(self, ids: np.ndarray, config: LanguageConfig) -> np.ndarray:
        """Each language's share of the text; zeros outside the chosen set."""
        share = np.zeros(len(self.names))
        if not len(ids):
            return share
        seen, weight = np.unique(ids, return_counts=True)
        logs = self.logs[seen]
        whole = weight @ logs
        chosen, best = [int(np.argmax(whole))], float(whole.max())
        share[chosen[0]] = 1.0
        top = logs.max(axis=1, keepdims=True)
        like = np.exp(logs - top)
        base, n = float(weight @ top[:, 0]), float(weight.sum())
        while len(chosen) < len(self.names):  # the penalised likelihood ends the search
            mixed = like @ share
            gain = {k: float(weight @ np.log(0.9 * mixed + 0.1 * like[:, k])) for k in range(len(self.names)) if k not in chosen}
            k = max(gain, key=gain.get)
            trial = [*chosen, k]
            part = np.append(share[chosen] * 0.9, 0.1)
            for _ in range(config.steps):
                each = like[:, trial] * part
                part = weight @ (each / each.sum(axis=1, keepdims=True)) / n
            value = base + float(weight @ np.log(like[:, trial] @ part))
            if value - best <= 0.5 * np.log(n) * max(config.orders):
                break
            chosen, best = trial, value
            share[:] = 0
            share[chosen] = part
        return share


def fit(labelled: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """The model of ``labelled`` (doc_id, text, lang); rows without text or lang teach nothing."""
    known = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    small_batches(labelled.sparkSession)
    by = Window.partitionBy("lang").orderBy("h")
    # the sample is chosen without its texts: at most sample_rows numbers for each language, so that it can be broadcast
    chosen = known.select("lang", "h").withColumn("n", F.row_number().over(by)).where(F.col("n") <= config.sample_rows).select("lang", "h").distinct()
    sample = known.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")
    size = 1 << config.bits

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), R.strings(batch.column("text"))):
                ids = gram_ids(np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8), config)
                found.setdefault(lang, np.zeros(size, np.int64))
                found[lang] += np.bincount(ids, minlength=size)
        for lang, counts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([counts.tobytes()], pa.binary())], ["lang", "counts"])

    # a fixed number of counts for each language of the bounded sample
    total: dict[str, np.ndarray] = {}
    for row in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        total[row["lang"]] = total.get(row["lang"], 0) + np.frombuffer(row["counts"], np.int64)
    names = sorted(total)
    counts = np.array([total[x] for x in names], float).reshape(len(names), size)
    return LanguageModel(names, np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * size)).T.copy())


def identify(docs: DataFrame, model: LanguageModel, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """``docs`` with lang_pred, score and langs (language and share, largest first).

    ``und``, score 0: the text is null or has no letter, or no language was learned.  All columns are kept; columns
    of these three names are replaced.  Texts count whole, ties go to the first language by name.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "langs")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets, of fixed size

    def run(batches):
        m = shared.value
        for batch in batches:
            names, scores, sets = [], [], []
            for text in R.strings(batch.column("text")):
                share = None
                if m.names and any(map(str.isalpha, text)):
                    share = m.mixture(gram_ids(np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8), config), config)
                if share is None or not share.any():
                    names.append("und"), scores.append(0.0), sets.append([])
                    continue
                order = [int(i) for i in np.argsort(-share, kind="stable") if share[i] > 0]
                names.append(m.names[order[0]])
                scores.append(float(min(1.0, share[order[0]])))
                sets.append([{"lang": m.names[i], "share": float(share[i])} for i in order])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind)], [*batch.schema.names, "lang_pred", "score", "langs"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{columns}, lang_pred string, score double, langs array<struct<lang:string,share:double>>")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: crc32 of the id modulo 3 is not 1."""
    return docs.select("doc_id", "text", "lang").where(R.remainder(F.col("doc_id"), 3) != 1)
