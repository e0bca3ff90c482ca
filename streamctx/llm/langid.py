"""Language identification in two steps by linear support vector machines.

A first machine for each family against the other families finds the family; within
it, a machine for each pair of languages votes. Features are hashed character
n-grams of words with their ends, as shares of a text's n-grams.

The fit uses about `sample` documents at most, spread evenly over languages and picked
by hash from the training fold; texts are predicted whole. Texts that are null
or have no letter get `und` with score 1. Without labelled texts every other text
gets `und` with score 0. A language outside FAMILIES is a family of its own. Votes that tie go to the wider margins,
then to the name. Repeated rows get equal answers; columns other than doc_id, text and lang are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

#: Languages by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky".split(),
    "semitic": "ar he mt am".split(),
    "indo-aryan": "hi bn ur pa mr gu ne si".split(),
}
WIDTH = 4096
LONGEST = 4
#: Characters that are counted at a time; a run's ends count as ends of words.
PIECE = 1 << 18


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter (of a Unicode category L)."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def family(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def ngrams(raw: str) -> np.ndarray:
    """How often each of WIDTH hashes of 1 to LONGEST characters stands in the lower-cased words of letters and their ends."""
    out = np.zeros(WIDTH, np.int64)
    for lo in range(0, len(raw), PIECE):
        code = np.frombuffer(raw[lo : lo + PIECE].lower().encode("utf-32-le", "replace"), "<u4")
        word = letters()[code]
        code = np.where(word, code, 0)[word | np.append(False, word[:-1])]  # one 0 after each word
        if not len(code):
            continue
        code = np.concatenate([[0], code, [0] if code[-1] else []]).astype(np.uint32)
        h, inner = code * np.uint32(0x9E3779B1), code != 0
        for n in range(1, LONGEST + 1):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + code[n - 1 :] * np.uint32(0xC2B2AE3D)
            # all characters but the first and the last are letters; a single one is
            fits = inner if n == 1 else np.logical_and.reduce([inner[k : len(inner) - n + 1 + k] for k in range(1, n - 1)]) if n > 2 else slice(None)
            own = h[fits]
            out += np.bincount(((own ^ (own >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=WIDTH)
    return out


def vector(raw: str) -> np.ndarray:
    """Shares of n-grams; zeros without letters."""
    found = ngrams(raw)
    return (found / max(1, found.sum())).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, *, steps: int = 300, c: float = 30.0) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss for y of -1 and 1, both classes weighed alike."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, m1, m2 = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, steps + 1):
        gap = np.maximum(0, 1 - y * (x @ w[:-1].astype(np.float32) + w[-1]))
        slope = (-2 * c * share * y * gap).astype(np.float32)
        grad = np.append(slope @ x, slope.sum()) + np.append(1e-4 * w[:-1], 0)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        w -= 0.5 / np.sqrt(step) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return w


class Model:
    """families: names; langs: of each family; weights: a row of WIDTH + 1 for each machine, families first, then each family's pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        langs = sorted(set(y))
        self.families = sorted({family(s) for s in langs})
        self.langs = {f: [s for s in langs if family(s) == f] for f in self.families}
        of = np.array([family(s) for s in y])
        rows = [machine(x, np.where(of == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = [(f, a, b) for f in self.families for a, b in combinations(self.langs[f], 2)]
        for _, a, b in self.pairs:
            mine = (y == a) | (y == b)
            rows.append(machine(x[mine], np.where(y[mine] == a, 1.0, -1.0)))
        self.weights = np.array(rows) if rows else np.zeros((1, WIDTH + 1))

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        """Language and score from all machines' outputs."""
        sure, at = 1.0, self.families[0]
        n = len(self.families) if len(self.families) > 1 else 0
        if n:
            best = int(np.argmax(margins[:n]))
            others = np.delete(margins[:n], best).max()
            at, sure = self.families[best], 1 / (1 + np.exp(-2 * (margins[best] - others)))
        votes = dict.fromkeys(self.langs[at], (0, 0.0))
        for (f, a, b), m in zip(self.pairs, margins[n:], strict=False):
            if f == at:
                win, lose = (a, b) if m >= 0 else (b, a)
                votes[win] = (votes[win][0] + 1, votes[win][1] + abs(m))
                votes[lose] = (votes[lose][0], votes[lose][1] - abs(m))
        lang = max(sorted(votes), key=lambda s: votes[s])
        for (f, a, b), m in zip(self.pairs, margins[n:], strict=False):
            if f == at and lang in (a, b):
                sure *= 1 / (1 + np.exp(-4 * (m if lang == a else -m)))
        return lang, float(sure)


def train(docs: DataFrame, *, sample: int = 4000, fold: Column | None = None, seed: int = 11) -> Model | None:
    """A model from rows of docs (doc_id, text, lang) for which `fold` holds; None if none has a language and a letter."""
    known = docs.where((F.lit(True) if fold is None else fold) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = sample / len(counts)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])[F.col("lang")]
    rows = known.where(u < share).select("lang", "text")

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [vector(x.decode("utf-8", "replace")).tobytes() for x in text.as_bytes(batch.column("text"))]
        return pa.record_batch([batch.column("lang"), pa.array(found, pa.binary())], ["lang", "v"])

    got = sorted((r["lang"], bytes(r["v"])) for r in rows.mapInArrow(text.batches(vectors), "lang string, v binary").collect())
    x = np.array([np.frombuffer(v, np.float32) for _, v in got]).reshape(-1, WIDTH)
    y = np.array([lang for lang, _ in got])
    there = x.any(axis=1)
    return Model(x[there], y[there]) if there.any() else None


def predict(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers for each machine

    def predicted(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, langs, sure = shared.value, [], []
        for lo in range(0, batch.num_rows, 256):
            for raw in text.as_bytes(batch.column("text").slice(lo, 256)):
                x = vector(raw.decode("utf-8", "replace"))
                there = bool(x.any())
                lang, p = model.decide(model.weights[:, :-1] @ x + model.weights[:, -1]) if there and model else ("und", float(not there))
                langs.append(lang)
                sure.append(p)
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(text.batches(predicted), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, *, modulus: int = 4, remainder: int = 2, **how: object) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs; rows with crc32(doc_id) mod `modulus` = `remainder` are held out from training."""
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder
    return predict(docs, train(docs, fold=~out, **how), F.coalesce(out, F.lit(False)))
